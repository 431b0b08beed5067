"""Extraction, ownership and sources on small inputs; what SQL cannot say is compared with plain versions or examples."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from tessera.functions import extract, names, ownership, relevance, text
from tessera.operators import upkeep
from tessera.sources import feeds
from tests.test_operators import one

BOILER = ["subscribe", "all rights reserved"]


def plain_score(p):
    words, low = p.split(), p.lower()
    if len(words) < 8:
        return -5
    s = min(len(words), 80)
    s -= 45 * any(b in low for b in BOILER)
    s -= 35 * (bool(re.search(r"\b(read more|subscribe|sign up|related|trending)\b", low)) and len(words) < 25)
    s -= 25 * (sum(p.count(c) for c in "|›»") > 2)
    s -= 10 * (sum(not c.isalnum() and not c.isspace() for c in p) / len(p) > 0.25 and len(words) < 20)
    s += 20 * bool(re.search(r"\b(said|according|reported|campaign|candidate|election|district|assembly|council|primary)\b", low))
    return s + 8 * (p[-1] in ".!?")


def test_paragraphs(spark):
    body = "The council said on Monday that the bridge over the river will be open by the end of spring."
    ps = [body, body.upper(), "Too short.", "Subscribe now to our letter and get all of it every single day", "a | b | c | d | e f g h i j", "The bridge opens at last", "x " * 200]
    html = "<html><script>var a = '<p>no</p>';</script>" + "".join(f"<p>{p}</p>\n" for p in ps) + "</html>"
    df = spark.createDataFrame([(p,) for p in ps], "p string")
    got = [r.s for r in df.select(extract.paragraph_score(F.col("p"), BOILER).alias("s")).collect()]
    assert got == [plain_score(p) for p in ps]
    kept = one(spark, extract.paragraphs(F.col("h"), F.lit("The bridge opens at last"), BOILER), h=html)
    assert kept == [p.strip() for p in ps if plain_score(p) > 0 and p != body.upper() and p != "The bridge opens at last"]
    q = one(spark, extract.extraction_quality(F.col("t"), F.lit("Title"), F.lit(None).cast("string"), F.lit(1), BOILER), t="word " * 100)
    assert (q.score, q.label) == (100, "good")
    q = one(spark, extract.extraction_quality(F.col("t"), F.lit("Title"), F.col("t"), F.lit(1), BOILER), t="Subscribe now. Sign up here. All rights reserved.")
    assert (q.score, q.label) == (100 - 24 - 16 - 10, "mixed")


def test_dates_and_titles(spark):
    d = lambda h: one(spark, extract.html_date(F.col("h")), h=h)
    assert d('<meta property="article:published_time" content="2024-03-01T10:00:00Z">').date() == dt.date(2024, 3, 1)
    assert d("<meta content='2024-03-02' name='pubdate'>").date() == dt.date(2024, 3, 2)
    assert d('<script type="application/ld+json">{"a": 1, "datePublished": "2024-03-03"}</script>').date() == dt.date(2024, 3, 3)
    assert d('<time class="x" datetime="2024-03-04">').date() == dt.date(2024, 3, 4) and d('<time datetime="10:00">') is None and d("none") is None
    assert one(spark, extract.clean_title(F.col("t")), t=" A☀ b&amp;c \U0001f600 \n d<e ") == "A b&c d<e"
    assert one(spark, extract.without_fillers(F.col("t"), ["this week", "recently"]), t="Recently, the mayor spoke this week.") == "The mayor spoke."
    assert json.loads(one(spark, extract.repaired_json(F.col("t")), t='{"a": "x"\n "b": [1, 2,],}')) == {"a": "x", "b": [1, 2]}
    assert one(spark, extract.repaired_names(F.col("t"), ["Jane Kowalski"]), t="then Kowalsky said to Kow and Jan and Kowalskee") == "then Kowalski said to Kow and Jan and Kowalski"
    assert one(spark, extract.anonymised(F.col("t"), {"Roe": "the opponent", "Jane Roe": "the candidate"}), t="Jane Roe's plan and ROE, not Roehm") == "the candidate's plan and the opponent, not Roehm"
    assert not one(spark, extract.refusal(F.col("t"), ["i cannot"], ["n/a"]), t="I cannot say") and one(spark, extract.refusal(F.col("t"), ["i cannot"], ["n/a."]), t="N/A")
    assert one(spark, extract.quote_found(F.col("q"), F.lit("He said: “We WILL win!” today")), q="we will win") and not one(spark, extract.quote_found(F.col("q"), F.lit("x")), q="...")


def test_names(spark):
    p = lambda n: one(spark, names.without_honorifics(F.col("n")), n=n)
    assert [p("Prof. Dr. Ann Lee, Ph.D."), p("Lt. Col. Ann Lee III"), p("Justice Ann Lee V"), p("Chief Justice Lee JD"), p("Ann Lee")] == ["Ann Lee", "Ann Lee", "Ann Lee", "Lee", "Ann Lee"]
    assert one(spark, text.platform(F.col("u"), F.lit(None).cast("string")), u="https://nitter.example/x") == "twitter" and one(spark, text.platform(F.col("u"), F.lit("Daily")), u="https://notx.com/a") is None


def test_owner_inversion(spark):
    a = lambda t, n="Jane Roe": one(spark, ownership.attacks(F.col("t"), n, ["cuts", "broke"], ["scandal", "corruption"], ["voted to cut"]), t=t)
    assert a("Roe cuts funding") and a("Roe's big spending scandal") and a("Roe voted to cut aid") and a("Roe broke it", "ROE, JANE")
    assert not a("Roe's anti-corruption plan") and not a("Funding cuts hurt Roe") and not a("Roe's fight") and not a("x", "Li")
    c = lambda o, x, y: spark.range(1).select(ownership.corrected_owner(F.lit(o), F.lit(x), F.lit(y)).alias("o")).first().o
    assert [c("opponent", False, True), c("candidate", True, False), c("candidate", True, True), c("media", True, False)] == ["candidate", "opponent", "candidate", "media"]
    k = one(spark, ownership.sentence_kinds(F.col("s"), "Roe", "Doe", ["criticized"], ["said"], ["will"]), s="Roe said she will sue Doe")
    assert (k.attack, k.claim, k.promise, k.verify) == (False, True, True, True)
    assert one(spark, ownership.sentence_kinds(F.col("s"), "Roe", "Doe", ["criticized"], [], []), s="Doe criticized Roe") is None


def test_sources(spark, tmp_path):
    raw = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows] + [("broken {",)], "value string")
    none = spark.createDataFrame([], "url string, title string")
    known = spark.createDataFrame([("http://k", "t")], "url string, title string")
    post = {"id": "1", "title": "Bridge vote", "selftext": "x", "permalink": "/r/1/", "author": "a", "created": 0.0, "comments": [{"id": "c", "body": "the bridge!", "author": "b", "created": 1.0}, {"id": "d", "body": "off", "author": "b", "created": 2.0}]}
    assert sorted(r.url for r in feeds.threads(raw(post, {**post, "id": "2", "title": "Other", "permalink": "/r/2/"}), ["bridge"]).collect()) == ["/r/1/", "/r/1/c"]
    s = {"uri": "http://s/1", "content": "<p>The <b>bridge</b></p>", "account": "z", "created_at": "2024-01-01T00:00:00Z"}
    assert [r.body for r in feeds.statuses(raw(s, s, {**s, "uri": "http://k"}, {**s, "uri": "http://s/2", "content": "no"}), ["bridge"], known).collect()] == ["The bridge"]
    f = {"id": "9", "committee": "C", "form": "24", "amount": 1500.0, "support": "O", "date": "2024-02-01", "url": "http://f"}
    assert [r.title for r in feeds.filings(raw(f, {**f, "url": "http://k"}), known).collect()] == ["C filed 24 opposing $1,500"]
    q = {"market": "m", "at": "2024-01-01T00:00:00Z", "outcomes": [{"name": "a", "bid": 0.5, "ask": 0.54, "last": 0.9}, {"name": "b", "bid": None, "ask": None, "last": 0.4}]}
    assert {(r.side, r.pct, r.spread) for r in feeds.quotes(raw(q)).collect()} == {("a", 52.0, 4.0), ("b", 40.0, None)}
    t = {"video": "v", "segments": [{"start": 2.0, "text": " b"}, {"start": 1.0, "text": "a\n"}]}
    assert [(r.video, r.text) for r in feeds.transcript(raw(t)).collect()] == [("v", "a b")]
    prices = lambda *v: spark.createDataFrame([(dt.datetime(2024, 1, d, h), p) for d, h, p in v], "at timestamp, pct double")
    assert {(r.day.day, r.own, r.other) for r in feeds.history(prices((1, 1, 5.0), (1, 2, 6.0)), prices((1, 1, 94.0), (2, 1, 93.0))).collect()} == {(1, 6.0, 94.0), (2, None, 93.0)}
    w = spark.range(1).select(feeds.windows(F.lit("2024-01-01").cast("date"), F.lit("2024-01-08").cast("date"), 3).alias("w")).first().w
    assert [(a.start.day, a.end.day) for a in w] == [(1, 4), (4, 7), (7, 8)]
    assert feeds.written(spark, "t", "b").first().kind == "manual" and none.count() == 0
    (tmp_path / "p.tsv").write_text("USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG \nPA\t1\tAva borough\t41.0\t-75.5\nPA\t2\tFar city\t45.0\t-75.5\n")
    box = spark.createDataFrame([(-76.0, 40.0, -75.0, 42.0)], "west double, south double, east double, north double")
    assert [r.name for r in feeds.places_within(feeds.places(spark, str(tmp_path / "p.tsv")), box, "PA").collect()] == ["Ava"]
    (tmp_path / "c.json").write_text('{"a": 0.4,\n "b": "x"}')
    assert {(r["name"], r.value) for r in feeds.settings(spark, str(tmp_path / "c.json")).collect()} == {("a", "0.4"), ("b", "x")}
    for i in (1, 2):
        (tmp_path / f"{i}.xml").write_text(f"<rss><channel><item><title>T{i}</title><link>http://n/{i}?utm_source=x</link><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate></item><item><title>K</title><link>http://k</link></item></channel></rss>")
    new, marks = feeds.all_feeds(spark, [str(tmp_path / f"{i}.xml") for i in (1, 2)], known)
    assert sorted(r.title for r in new.collect()) == ["T1", "T2"] and [r["items"] for r in marks.collect()] == [2, 2]
    page = "<title>Bridge</title><p>The council said on Monday that the new bridge over the river is open now.</p><a href='http://n/a'>x</a><a href='/b'>y</a>"
    html = spark.createDataFrame([("http://seed", page), ("http://n/a#x", page), ("http://n/c", "<p>no</p>")], "url string, html string")
    assert sorted(r.url for r in feeds.pages(html, []).collect()) == ["http://n/a#x", "http://seed"]
    assert [r.url for r in feeds.crawled(html.limit(1), html, "^http://n/").collect()] == ["http://n/a#x"]
    g = spark.createDataFrame([(dt.date(2024, 1, 5), "u1", "jane roe", "x", "-2.0,1"), (dt.date(2024, 1, 6), "u1", "roe", None, "-4.0,1"), (dt.date(2023, 1, 1), "u2", "roe", "", "1"), (dt.date(2024, 1, 6), "u3", "doe", "", "bad")], "day date, url string, persons string, locations string, tone string")
    assert [tuple(r) for r in feeds.gkg(g, 30, F.lit("2024-01-10"), ["Roe"], 9).select("url", "tone", "mentions").collect()] == [("u1", -3.0, 2)]


def test_links_in_pages(spark):
    page = "<a href='http://p.example/1'>Mayor opens harbour bridge</a> <a class=x href=\"http://p.example/2\">About <b>us</b></a>"
    df = spark.createDataFrame([(1, page, "Mayor opens the harbour bridge")], "page long, html string, title string")
    got = [(r.link, r.similarity) for r in upkeep.link_candidates(df, F.col("link").contains("p.example"), "title").collect()]
    assert got == [("http://p.example/1", 1.0)]


def test_text_relevance_reads_whole_words_and_null_texts(spark):
    race = relevance.Race(candidate="Doe, Jane", opponents=("Dr. Max Roe Jr.",), district=("Elm",), geography=("que",))
    rows = [(1, "Doe said the vote was misleading", "news"), (2, "Does the équipe hope", None), (3, None, None), (4, "Roe at the GAME", "news"), (5, "nba recipe", "news")]
    docs = spark.createDataFrame(rows, "id int, text string, relevance string")
    none = F.lit(None).cast("string")
    got = relevance.text_relevance(docs, F.col("text"), none, none, F.col("relevance"), none, none, none, race)
    assert got.columns == ["id", "text", "relevance"]  # a column of that name gives way
    found = {r["id"]: r["relevance"] for r in got.collect()}
    assert found[1]["reasons"] == ["candidate", "election"] and found[1]["action"] == "respond"
    assert found[2]["reasons"] == [] and found[2]["score"] == 0  # neither "doe" nor "que" is a word of its own
    assert found[3]["label"] == "irrelevant" and found[3]["archived"]
    assert found[4]["category"] == "campaign" and found[4]["reasons"] == ["opponent"]
    assert found[5]["category"] == "sports" and found[5]["action"] == "ignore"
