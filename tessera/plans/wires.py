"""Public sources' answers, made of the driver tables as text, and parsed; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.media import NOW, _as_of, _day
from tessera.sources import feeds, tables
from tessera.sources.tables import table
from tessera.streaming import keywords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _json(rows: DataFrame, **fields) -> DataFrame:
    """rows as JSON lines, and one that is broken."""
    text = rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))
    return text.unionByName(rows.sparkSession.createDataFrame([("broken {",)], "value string"))


@query(r"""
with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') as u,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^utm_|^(fbclid|gclid|ref|ref_src|mc_cid|mc_eid)(=|$)'))) as k from pages)
select 'Item ' || page_id as title, u || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end as url, strftime(timestamp '2024-01-01 10:00:00' + page_id * interval 1 hour, '%Y-%m-%d %H') as published from p""")
def feed_entries(spark, d):
    at = F.expr("timestamp_seconds(1704103200 + page_id * 3600)")
    when = F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    xml = F.concat(F.lit("<item><title> Item "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>"), when, F.lit("</pubDate></item>"))
    return feeds.entries(table(spark, d, "pages").select(xml.alias("value"))).select("title", "url", F.date_format("published", "yyyy-MM-dd HH").alias("published"))


@query("""
select 'C' || o_custkey || ' filed F' || (o_orderkey % 3) || case o_orderstatus when 'F' then ' supporting' when 'O' then ' opposing' else '' end || ' $' || format('{:,}', cast(floor(o_totalprice) as bigint)) as title, 'http://filings/' || o_orderkey as url, strftime(o_orderdate, '%Y-%m-%d') as published
from orders where o_orderkey % 4 > 0""")
def filings(spark, d):
    o = table(spark, d, "orders")
    raw = _json(o, id=F.col("o_orderkey").cast("string"), committee=F.concat(F.lit("C"), F.col("o_custkey").cast("string")), form=F.concat(F.lit("F"), (F.col("o_orderkey") % 3).cast("string")), amount=F.floor("o_totalprice").cast("double"), support=F.when(F.col("o_orderstatus") == "F", "S").when(F.col("o_orderstatus") == "O", "O"), date=_day("o_orderdate"), url=F.concat(F.lit("http://filings/"), F.col("o_orderkey").cast("string")))
    known = o.where("o_orderkey % 4 = 0").select(F.concat(F.lit("http://filings/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("-").alias("title"))
    return feeds.filings(raw, known).select("title", "url", _day("published").alias("published"))


@query("""
with p as (select conv_id from conversations group by 1 having count(case when turn = 0 and role = 'user' then 1 end) > 0)
select '/c/' || conv_id || '/' as url, 'user' as author from p union all select '/c/' || conv_id || '/' || turn, role from conversations where turn > 0 and role = 'user' and conv_id in (select conv_id from p)""")
def forum_threads(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat_ws(" ", "role", "text").alias("text"))
    said = F.when(F.col("turn") > 0, F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("body"), F.col("role").alias("author"), F.col("turn").cast("double").alias("created")))
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.struct("role", "text"))).alias("p"), F.collect_list(said).alias("comments"))
    head = F.when(F.col("p.role") == "user", F.lit("the user asks")).otherwise(F.lit("nobody asks"))
    raw = _json(g, id=F.col("conv_id").cast("string"), title=head, selftext=F.lit(""), permalink=F.concat(F.lit("/c/"), F.col("conv_id").cast("string"), F.lit("/")), author=F.col("p.role"), created=F.lit(0.0), comments=F.filter("comments", lambda x: x["author"] == "user"))
    return feeds.threads(raw, ["user"]).select("url", "author")


@query("""select 'http://s/' || conv_id || '/' || turn as url, md5(role || ' & ' || turn) as digest from conversations where role = 'assistant' and turn % 3 > 0""")
def timelines(spark, d):
    c = table(spark, d, "conversations")
    uri = F.concat_ws("/", F.lit("http://s"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    raw = _json(c, uri=uri, content=F.concat(F.lit("<p><b>"), "role", F.lit("</b> &amp; "), F.col("turn").cast("string"), F.lit("</p>")), account=F.col("role"), created_at=F.lit("2024-01-01T00:00:00Z"))
    known = c.where("turn % 3 = 0").select(uri.alias("url"))
    return feeds.statuses(raw.unionAll(raw), ["assistant"], known).select("url", F.md5("body").alias("digest"))


@query("""
select cast(user_id as varchar) as market, 'own' as side, round((cast(user_id % 50 as double) / 100 + cast(event_id % 10 as double) / 100) * 50, 1) as middle, strftime(ts, '%Y-%m-%d') as day from events where event_id % 2 = 0
union all select cast(user_id as varchar), 'own', round(cast(event_id % 100 as double), 1), strftime(ts, '%Y-%m-%d') from events where event_id % 2 = 1""")
def market_quotes(spark, d):
    e = table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    side = F.struct(F.lit("own").alias("name"), F.when(even, F.col("user_id") % 50 / 100).alias("bid"), F.when(even, F.col("event_id") % 10 / 100).alias("ask"), F.when(~even, F.col("event_id") % 100 / 100).alias("last"))
    raw = _json(e, market=F.col("user_id").cast("string"), at=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), outcomes=F.array(side))
    return feeds.quotes(raw).select("market", "side", F.round("pct", 1).alias("middle"), _day("at").alias("day"))


@query("""
with a as (select strftime(ts, '%Y-%m-%d') as day, arg_max(value, (ts, value)) as own from events where event_type = 'view' group by 1), b as (select strftime(ts, '%Y-%m-%d') as day, arg_max(value, (ts, value)) as other from events where event_type = 'click' and value > 90 group by 1)
select day, coalesce(round(own, 3), -1) as own, coalesce(round(other, 3), -1) as other from a full join b using (day)""")
def market_history(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").alias("at"), F.col("value").alias("pct"))
    out = feeds.history(e.where("event_type = 'view'"), e.where("event_type = 'click' and pct > 90"))
    return out.select(_day("day").alias("day"), *[F.round(F.coalesce(c, F.lit(-1.0)), 3).alias(c) for c in ("own", "other")])


@query("select cast(conv_id as varchar) as video, md5(string_agg(role || turn, ' ' order by turn)) as digest from conversations group by 1")
def transcripts(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), F.concat(F.lit(" "), "role", F.col("turn").cast("string"), F.lit("\n")).alias("text"))).alias("s"))
    raw = _json(c, video=F.col("conv_id").cast("string"), segments=F.col("s"))
    return feeds.transcript(raw).select("video", F.md5("text").alias("digest"))


@query("""select 'at://' || user_id || '/app.bsky.feed.post/' || event_id as uri, event_type as text from events where event_id % 3 > 0""")
def firehose_events(spark, d):
    e = table(spark, d, "events")
    commit = F.struct(F.when(F.col("event_id") % 3 > 0, "create").otherwise("delete").alias("operation"), F.lit("app.bsky.feed.post").alias("collection"), F.col("event_id").cast("string").alias("rkey"), F.struct(F.col("event_type").alias("text"), F.lit("2024-01-01T00:00:00Z").alias("createdAt")).alias("record"))
    return keywords.decoded(_json(e, did=F.col("user_id").cast("string"), commit=commit)).select("uri", "text")


@query("""select uri, keyword from (select user_id || '-' || (event_id // 2) as uri, case when contains(t, 'click') then 'click' when contains(t, 'view') then 'view' end as keyword, row_number() over (partition by user_id, event_id // 2 order by event_id) as r from (select *, lower(event_type) as t from events) where contains(t, 'click') or contains(t, 'view')) where r = 1 and keyword = 'click' or r = 1 and keyword = 'view'""")
def deduplicated_posts(spark, d):
    """The stream's write path as a batch: matched by keyword, and once an address; a streaming run of it is in the tests."""
    e = table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 2).cast("string")).alias("uri"), F.col("event_type").alias("text"), "event_id")
    hit = keywords.matched(e, "text", ["view", "click"])
    return hit.groupBy("uri").agg(F.min_by("keyword", "event_id").alias("keyword"))


@query(f"""select 'u' || user_id as url, round(avg(value), 3) as tone, count(*) as mentions, strftime(min(cast(ts as date)), '%Y-%m-%d') as first from events where cast(ts as date) > cast({NOW} as date) - 14 and cast(ts as date) <= cast({NOW} as date) and (event_type = 'view' or event_type = 'error') group by 1 order by mentions desc, url limit 20""")
def knowledge_graph(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.upper("event_type").alias("persons"), F.lit(None).cast("string").alias("locations"), F.concat(F.col("value").cast("string"), F.lit(",1,2")).alias("tone"))
    out = feeds.gkg(e, 14, _as_of(spark, d), ["View", "error"], 20)
    return out.select("url", F.round("tone", 3).alias("tone"), "mentions", _day("first").alias("first"))


@query("""
with s as (select cast(date_trunc('day', min(o_orderdate)) as date) as a, cast(date_trunc('day', max(o_orderdate)) as date) as b from orders), w as (select cast(unnest(generate_series(cast(a as timestamp), cast(b - 1 as timestamp), interval 30 day)) as date) as w, b from s)
select strftime(w, '%Y-%m-%d') as start, count(o_orderkey) as orders from w left join orders on o_orderdate >= w and o_orderdate < least(w + 30, b) group by 1""")
def backfill_windows(spark, d):
    """What each window of a backfill brings: orders meet the windows on the window's number, not by range."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    s = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    w = s.select(F.posexplode(feeds.windows(F.col("a"), F.col("b"), 30)).alias("i", "w"))
    a, b = s.first()
    n = o.where(F.col("day") < b).groupBy(F.floor(F.datediff("day", F.lit(a)) / 30).alias("i")).agg(F.count("*").alias("orders"))
    return w.join(n, "i", "left").select(_day("w.start").alias("start"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""select 'H' || '-' || p_partkey as id, case when p_partkey % 5 = 0 then 'unknown type' when p_partkey % 7 = 0 then 'missing name' else '-' end as reason from part""")
def tagged_imports(spark, d):
    """Lines of an import as CSV: good rows and rejects with their reasons."""
    p = table(spark, d, "part")
    line = F.concat_ws(",", F.when(F.col("p_partkey") % 5 == 0, "nonsense").otherwise(" Opponent "), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit('"'), "p_name", F.lit(', Jr."'))), F.concat(F.lit("H-"), F.col("p_partkey").cast("string")))
    rows = p.select(F.from_csv(line, F.lit("type string, name string, url string")).alias("r")).select("r.*").withColumn("_bad", F.lit(None).cast("string"))
    good, bad = tables.tagged(rows, ["opponent", "campaign"])
    return good.select(F.col("url").alias("id"), F.lit("-").alias("reason")).unionByName(bad.select(F.col("url").alias("id"), "reason"))


@query("""select '2024-' || upper(substr(c_mktsegment, 1, 2)) || '-H-' || lpad(cast(c_nationkey as varchar), 2, '0') as race_key, count(*) as candidates from customer where c_custkey % 3 < 2 group by 1""")
def race_directory(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("CAND_ID"), F.lit("2024").alias("CAND_ELECTION_YR"), F.upper(F.substring("c_mktsegment", 1, 2)).alias("CAND_OFFICE_ST"), F.lit("H").alias("CAND_OFFICE"), F.col("c_nationkey").cast("string").alias("CAND_OFFICE_DISTRICT"), F.element_at(F.array(F.lit("C"), F.lit("N"), F.lit("P")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("CAND_STATUS"))
    races, candidates = tables.race_rows(c)
    return candidates.join(races.select("race_key"), "race_key").groupBy("race_key").agg(F.count("*").alias("candidates"))


@query("""select cast(o_orderkey as varchar) as video, 'Jane Kowalski spoke of ' || o_orderkey as text from orders""")
def repaired_transcripts(spark, d):
    from tessera.functions import extract

    o = table(spark, d, "orders")
    said = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Jane Kowalsky").otherwise("Jane Kowalskee"), F.lit(" spoke of "), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").cast("string").alias("video"), extract.repaired_names(said, ["Jane Kowalski"]).alias("text"))
