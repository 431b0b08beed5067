"""Behaviour of operators on small, hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import scores, text, vectors
from tessera.operators import counts, graph, series, writes
from tessera.sources import tables
from tessera.streaming import keywords


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'array<double>'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_title_rules(spark):
    n = lambda a, b: one(spark, text.numbers_mismatch(text.title_numbers(F.col("a")), text.title_numbers(F.col("b"))), a=a, b=b)
    assert n("Ward 12 votes counted", "Ward 9 votes counted")
    assert not n("Harbour plan agreed", "Harbour plan agreed (case 71)")
    assert not n("Mayor speaks | Radio 1", "Mayor speaks | Radio 4")
    assert one(spark, text.title_tokens(F.col("a")), a="The Ward 12 Count - Morning Post") == ["ward", "12", "count"]
    assert one(spark, text.jaccard(text.title_tokens(F.col("a")), text.title_tokens(F.col("b"))), a="", b="x y") == 0
    assert one(spark, text.publisher_stripped(F.col("a")), a="A headline that is long enough - The Daily") == "a headline that is long enough"
    assert one(spark, text.publisher_stripped(F.col("a")), a="Short - The Daily") == "short - the daily"


def test_urls_and_platforms(spark):
    assert one(spark, text.canonical_url(F.col("u")), u="HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1#top") == "https://example.com/a?a=1&b=2"
    assert one(spark, text.domain(F.col("u")), u=None) is None
    assert one(spark, text.canonical_url(F.col("u")), u="http://a.example:8080/x?share=1&Amp=1&ref_url=u&sharedfrom=2&utm_id=7&empty=&flag&k=v") == "http://a.example:8080/x?k=v&utm_id=7"
    assert one(spark, text.canonical_url(F.col("u")), u="no host") is None
    p = lambda u, n: one(spark, text.platform(F.col("u"), F.col("n")), u=u, n=n)
    assert p("https://fed.brid.gy/r/https://bsky.app/profile/x", "Mastodon via x") == "bluesky"
    assert p("https://old.reddit.com/r/x", None) == "reddit" and p("https://a.example", "YouTube: x") == "youtube" and p("https://a.example", None) is None
    assert one(spark, text.junk_title(F.col("t"), ["untitled"]), t=" Untitled ") and one(spark, text.junk_title(F.col("t"), []), t="www.example.com") and not one(spark, text.junk_title(F.col("t"), []), t="A story")
    assert p("http://news.example/nitter-shuts-down", None) is None and p("https://nitter.poast.org/a", None) == "twitter" and p("https://mastodon.social/@a/1", None) == "mastodon" and p("https://x.mastodon.social/", None) is None
    assert one(spark, text.strip_html(F.col("h")), h="&mdash;&#8217;&eacute;&#x27;&#x1F600;&amp;lt; &nope; &#0; a&nbsp;&#160;b & c; &#xD800;") == "—’é'😀&lt; &nope; \ufffd a b & c; \ufffd"
    assert one(spark, text.strip_html(F.col("h")), h="<p>a&amp;b</p><script>x<y</script> <b>c</b>") == "a&b c"
    assert one(spark, text.humanise_name(F.col("n")), n="SMITH, JANE") == "Jane Smith"
    assert one(spark, text.json_list(F.col("j")), j="not json") == []


def test_scores(spark):
    b = lambda *v: one(spark, scores.blend(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=v[0], b=v[1], c=v[2], d=v[3])
    assert abs(b(62.0, 2.0, 45.5, 73.0) - 62) < 0.01 and b(50.0, 80.0, 40.0, 70.0) == 50.0
    assert one(spark, scores.confidence(F.col("s")), s=5.0) == 0.75
    assert one(spark, scores.trend(F.col("a"), F.col("b")), a=2, b=0) == "rising"
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == 1 / 2**0.5
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == -1


def test_pulse_and_health(spark):
    now = dt.datetime(2024, 1, 30, 12)
    rows = [("a", 1, dt.datetime(2024, 1, 29)), ("a", 1, dt.datetime(2024, 2, 20)), ("a", 2, dt.datetime(2024, 1, 20)), ("a", 3, None)]
    items = spark.createDataFrame(rows, "k string, c long, ts timestamp_ntz")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    out = {r.k: (r.this_week, r.last_week, r.total) for r in counts.pulse(items, keys, "k", "c", "ts", F.lit(now).cast("timestamp_ntz")).collect()}
    assert out == {"a": (1, 1, 2), "b": (0, 0, 0)}
    base = [("s", "x" * 2000, now - dt.timedelta(days=2, minutes=i)) for i in range(20)] + [("s", "x" * 70, now - dt.timedelta(hours=2, minutes=i)) for i in range(8)]
    h = counts.short_body(spark.createDataFrame(base, "s string, t string, ts timestamp_ntz"), "s", "ts", F.length("t"), F.lit(now).cast("timestamp_ntz")).first()
    assert h.fires and not h.recovers


def test_anchored_groups(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("t", t0 + dt.timedelta(hours=h)) for h in (0, 20, 25, 40, 49, 80)], "k string, ts timestamp")
    got = [(r.ts.hour + 24 * (r.ts.day - 1), r.group_start.hour + 24 * (r.group_start.day - 1)) for r in series.anchored_groups(df, "k", "ts", 24).orderBy("ts").collect()]
    assert got == [(0, 0), (20, 0), (25, 25), (40, 25), (49, 25), (80, 80)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert dict(graph.neighbourhood(e, start, 1).collect()) == {"a": 0, "b": 1, "c": 1}
    assert [tuple(r) for r in graph.simple_paths(e, start, spark.createDataFrame([("c",)], "node string"), 5).collect()] == [(["a", "b", "c"], 2)]
    assert dict(graph.components(e).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_writes(spark):
    old = spark.createDataFrame([(1, 5, 3, "h")], "k long, most long, least long, hash string")
    new = spark.createDataFrame([(1, 4, 2, None), (2, 1, 1, "z")], "k long, most long, least long, hash string")
    out = {r.k: tuple(r)[1:] for r in writes.merge(old, new, ["k"], ["most"], ["least"], ["hash"]).collect()}
    assert out == {1: (5, 2, "h"), 2: (1, 1, "z")}
    assert [tuple(r) for r in writes.changed(old, new, "k", ["hash"]).collect()] == [(1, "hash", "h", None)]
    assert writes.table_digest(old).first() == writes.table_digest(old.repartition(3)).first()


def test_sources(spark, tmp_path):
    (tmp_path / "a.psv").write_text("# comment\n" + "|".join(tables.CANDIDATE_MASTER) + "\nH1|DOE, JANE|X|2026|PA|H|8|C|C|||||PA|1\n")
    races, people = tables.race_rows(tables.candidate_master(spark, str(tmp_path / "a.psv")))
    assert races.first().race_key == "2026-PA-H-08" and people.count() == 1
    (tmp_path / "b.csv").write_text("type,name,url,notes,category,source_type,office,district,party,location,election_date,key_priorities\nrss_feed,A,http://x,,,,,,,,,\nwhat,B,,,,,,,,,,\nrss_feed,,,,,,,,,,,\n")
    good, bad = tables.tagged_csv(spark, str(tmp_path / "b.csv"), ["rss_feed"])
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["missing name", "unknown type"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    assert tables.feed(spark, str(tmp_path / "f.xml")).first()[:2] == ("A", "http://x")
    (tmp_path / "g.json").write_text('{"features": [{"geometry": {"coordinates": [[[1, 2], [3, -4], [1, 2]]]}}]}')
    assert tuple(tables.geojson_box(spark, str(tmp_path / "g.json")).first()) == (1, -4, 3, 2)


def test_stream(spark, tmp_path):
    """The stream's rows are the batch's, repeats dropped."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.unionByName(events.limit(50)).withColumn("text", F.concat("event_type", "props"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = keywords.deduplicated(keywords.matched(stream, "text", ["click", "error"]), "event_id", "ts", "40 days")
    q = out.select("event_id", "keyword").writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = keywords.matched(events.withColumn("text", F.concat("event_type", "props")), "text", ["click", "error"])
    assert sorted(spark.table("kept").collect()) == sorted(want.select("event_id", "keyword").collect())


def test_firehose_decode(spark):
    good = '{"did": "d", "commit": {"operation": "create", "collection": "app.bsky.feed.post", "rkey": "r", "record": {"text": "hi", "createdAt": "2024-01-01T00:00:00Z"}}}'
    rows = [(good,), (good.replace("create\"", "delete\""),), ("junk",), (good.replace('"hi"', '""'),)]
    assert [r.uri for r in keywords.decoded(spark.createDataFrame(rows, "value string")).collect()] == ["at://d/app.bsky.feed.post/r"]
