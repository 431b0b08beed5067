"""Answers of public services as rows: the parsing half of each source.  What was fetched lies in files, one JSON document a line unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.extract import clean_title, html_date, paragraphs
from tessera.functions.text import canonical_url, keyword_pattern, strip_html

ITEM = "title string, url string, body string, author string, published timestamp, kind string"


def _item(rows: DataFrame, title: Column, url: Column, body: Column, author: Column, published: Column, kind: str) -> DataFrame:
    return rows.select(clean_title(title).alias("title"), url.alias("url"), body.alias("body"), author.alias("author"), published.cast("timestamp").alias("published"), F.lit(kind).alias("kind"))


def all_feeds(spark: SparkSession, paths: list[str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new items, marks) of many RSS files in one read: urls not yet known, once each; marks: how many items each file gave."""
    rows = feed_files(spark, paths).withColumn("url", canonical_url(F.col("link")))
    marks = rows.groupBy("file").agg(F.count("*").alias("items"), F.max("published").alias("latest"))
    new = rows.dropDuplicates(["url"]).join(known.select(canonical_url(F.col("url")).alias("url")), "url", "left_anti")
    return _item(new, F.col("title"), F.col("link"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("published"), "news"), marks


def entries(raw: DataFrame, value: str = "value") -> DataFrame:
    """(title, url, published) of RSS items, one XML element a row; what does not parse has no title."""
    x = raw.select(F.from_xml(value, "title string, link string, pubDate string").alias("x")).select("x.*")
    return x.select(F.trim("title").alias("title"), canonical_url(F.trim("link")).alias("url"), _mail_date(F.col("pubDate")).alias("published"))


def _mail_date(text: Column) -> Column:
    """A date as e-mail writes it, without its weekday."""
    when = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    return F.coalesce(*[F.try_to_timestamp(when, F.lit(f"d MMM yyyy HH:mm:ss {z}")) for z in ("z", "xx")])


def feed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items of several RSS files with the file each stands in."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(paths)
    return x.select(F.trim("title").alias("title"), F.trim("link").alias("link"), _mail_date(F.col("pubDate")).alias("published"), F.input_file_name().alias("file"))


def pages(html: DataFrame, boilerplate: list[str]) -> DataFrame:
    """Items of fetched pages (url, html): title, paragraphs and date from the markup; pages without a paragraph are left out."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    rows = html.withColumn("_p", paragraphs(F.col("html"), title, boilerplate)).where(F.size("_p") > 0)
    return _item(rows, title, F.col("url"), F.array_join("_p", "\n\n"), F.lit(None).cast("string"), html_date(F.col("html")), "news")


def written(spark: SparkSession, title: str, body: str, url: str | None = None, author: str | None = None) -> DataFrame:
    """An item that a user typed in."""
    return spark.createDataFrame([(title, url, body, author, None, "manual")], ITEM)


def crawled(seeds: DataFrame, store: DataFrame, pattern: str) -> DataFrame:
    """Pages (url, html) of the store that a seed page (url, html) links to by an address that fits the pattern, each once."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:a\b[^>]*\bhref\s*=\s*[\"']|loc>)([^\"'<]+)"), F.lit(1)))
    found = seeds.select(link.alias("url")).where(F.col("url").rlike(pattern)).select(canonical_url(F.col("url")).alias("_c")).distinct()
    return store.withColumn("_c", canonical_url(F.col("url"))).join(found, "_c", "left_semi").drop("_c")


def places(spark: SparkSession, path: str) -> DataFrame:
    """Places of a tab-separated gazetteer: state, name, lat, lon; names without what kind of place it is."""
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    name = F.regexp_replace("NAME", r"(?i)\s+(city|town|borough|village|CDP|township)$", "")
    return rows.select(F.col("USPS").alias("state"), name.alias("name"), F.col("INTPTLAT").cast("double").alias("lat"), F.trim("INTPTLONG").cast("double").alias("lon"))


def places_within(places_: DataFrame, box: DataFrame, state: str) -> DataFrame:
    """Places of the state inside a one-row box (west, south, east, north)."""
    b = box.first()
    return places_.where((F.col("state") == state) & F.col("lat").between(b["south"], b["north"]) & F.col("lon").between(b["west"], b["east"]))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a JSON object in one file, values as text."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


def gkg(rows: DataFrame, days: int, as_of: Column, names: list[str], most: int) -> DataFrame:
    """Addresses of a knowledge graph's rows (day date, url, persons, locations, tone) that name someone in the last `days`: mean tone, mentions and first day, the most mentioned first."""
    tone = F.try_element_at(F.split("tone", ","), F.lit(1)).try_cast("double")
    named = F.lower(F.concat_ws(";", "persons", "locations")).rlike("|".join(n.lower() for n in sorted(names)))
    some = rows.where((F.col("day") > F.date_sub(as_of.cast("date"), days)) & (F.col("day") <= as_of.cast("date")) & named)
    return some.groupBy("url").agg(F.avg(tone).alias("tone"), F.count("*").alias("mentions"), F.min("day").alias("first")).orderBy(F.desc("mentions"), "url").limit(most)


def windows(start: Column, end: Column, days: int) -> Column:
    """The pieces of `days` days from start to end, as an array of structs (start, end): what a backfill asks for, one after the other."""
    return F.transform(F.sequence(start, F.date_sub(end, 1), F.make_dt_interval(F.lit(days))), lambda a: F.struct(a.alias("start"), F.least(F.date_add(a, days), end).alias("end")))


def filings(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Expenditures and filings (JSON: id, committee, form, amount, support, date, url) as items not yet known by url or title."""
    j = raw.select(F.from_json("value", "id string, committee string, form string, amount double, support string, date string, url string").alias("j")).select("j.*").where("id is not null")
    side = F.when(F.col("support") == "S", "supporting").when(F.col("support") == "O", "opposing")
    title = F.concat_ws(" ", "committee", F.lit("filed"), "form", side, F.when(F.col("amount").isNotNull(), F.concat(F.lit("$"), F.format_number("amount", 0))))
    j = j.join(known.select("url").distinct(), "url", "left_anti")
    items = _item(j, title, F.col("url"), title, F.col("committee"), F.try_to_timestamp("date"), "public_record").dropDuplicates(["url", "title"])
    # Distinct: one title that all known rows have is folded into the condition, and every item would meet every row.
    return items.join(known.select("title").distinct(), "title", "left_anti").select("title", "url", "body", "author", "published", "kind")


def threads(raw: DataFrame, words: list[str]) -> DataFrame:
    """Posts of a forum (JSON: id, title, selftext, permalink, author, created, comments of id, body, author, created) and those comments that hold a word."""
    j = raw.select(F.from_json("value", "id string, title string, selftext string, permalink string, author string, created double, comments array<struct<id: string, body: string, author: string, created: double>>").alias("j")).select("j.*").where("id is not null")
    pattern = keyword_pattern(words)
    posts = j.where(F.concat_ws(" ", "title", "selftext").rlike(pattern))
    said = posts.select("title", "permalink", F.explode("comments").alias("c")).where(F.col("c.body").rlike(pattern))
    a = _item(posts, F.col("title"), F.col("permalink"), F.col("selftext"), F.col("author"), F.timestamp_seconds("created"), "social")
    return a.unionByName(_item(said, F.concat(F.lit("Re: "), "title"), F.concat("permalink", F.col("c.id")), F.col("c.body"), F.col("c.author"), F.timestamp_seconds("c.created"), "social"))


def statuses(raw: DataFrame, words: list[str], known: DataFrame) -> DataFrame:
    """Posts of timelines or author feeds (JSON: uri, content in HTML or text, account, created_at) with a word, not yet known, once each."""
    j = raw.select(F.from_json("value", "uri string, content string, account string, created_at string").alias("j")).select("j.*").where("uri is not null")
    body = strip_html(F.col("content"))
    some = j.where(body.rlike(keyword_pattern(words))).dropDuplicates(["uri"]).join(known.select(F.col("url").alias("uri")), "uri", "left_anti")
    return _item(some, F.concat(F.lit("Post by "), "account"), F.col("uri"), body, F.col("account"), F.try_to_timestamp("created_at"), "social")


def quotes(raw: DataFrame) -> DataFrame:
    """(market, side, pct, spread, at) of markets (JSON: market, at, outcomes of name, bid, ask, last from 0 to 1): the middle of bid and ask, else the last price."""
    j = raw.select(F.from_json("value", "market string, at string, outcomes array<struct<name: string, bid: double, ask: double, last: double>>").alias("j")).select("j.market", F.try_to_timestamp("j.at").alias("at"), F.explode("j.outcomes").alias("o"))
    middle = F.coalesce((F.col("o.bid") + F.col("o.ask")) / 2, F.col("o.last"))
    return j.select("market", F.col("o.name").alias("side"), F.round(middle * 100, 2).alias("pct"), F.round((F.col("o.ask") - F.col("o.bid")) * 100, 2).alias("spread"), "at")


def history(own: DataFrame, other: DataFrame) -> DataFrame:
    """(day, own, other) of two sides' prices (at, pct): the last of each day, days of either."""
    last = lambda d, n: d.groupBy(F.to_date("at").alias("day")).agg(F.max_by("pct", "at").alias(n))
    return last(own, "own").join(last(other, "other"), "day", "full")


def rating(html: Column, cell: str, labels: dict[str, str]) -> Column:
    """The label of the rating in a page's cell (a pattern with one group); null for what is not in labels."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.try_element_at(table, strip_html(F.regexp_extract(html, cell, 1)))


def transcript(raw: DataFrame) -> DataFrame:
    """(video, text) of captions (JSON: video, segments of start, text): the segments in order as one text."""
    j = raw.select(F.from_json("value", "video string, segments array<struct<start: double, text: string>>").alias("j")).select("j.*").where("video is not null")
    ordered = F.array_sort(F.transform(F.col("segments"), lambda s: F.struct(s["start"].alias("start"), s["text"].alias("text"))))
    return j.select("video", F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda s: s["text"]), " "), r"\s+", " ")).alias("text"))
