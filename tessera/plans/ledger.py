"""Writes, matching, series and reports on the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import counts, ledger, review
from tessera.plans.media import NOW, _as_of, _centroids, _day
from tessera.sources import feeds
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _e(spark, d):
    return table(spark, d, "events")


def _pick(column, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


@query("""
select user_id as opponent, event_id % 3 as story, lower(event_type) as claim, min(event_id) as first_seen, max(event_id) as last_seen from events group by 1, 2, 3""")
def activity_upsert(spark, d):
    e = _e(spark, d)
    text = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type"))
    a = e.select(F.col("user_id").alias("opponent"), (F.col("event_id") % 3).alias("story"), text.alias("claim"), F.lit(None).cast("string").alias("attack"), F.lit(None).cast("string").alias("promise"), F.col("event_id").alias("at"))
    out = ledger.activities(a.where("at % 5 = 0"), a.where("at % 5 > 0"))
    return out.select("opponent", "story", F.lower(F.trim("claim")).alias("claim"), "first_seen", "last_seen")


@query("""
with i as (select event_id as id, user_id as story, user_id % 4 + event_id % 3 as a, ts from events), l as (select * from i where id % 4 > 0), s as (select story, min(id) as rep from i group by 1), b as (select story, arg_min(id, (-a, epoch_us(ts), id)) as best from l group by 1)
select story, case when rep % 4 = 0 then best else rep end as representative from s join b using (story)""")
def safe_delete(spark, d):
    i = _e(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("story"), (F.col("user_id") % 4 + F.col("event_id") % 3).alias("authority"), "ts")
    s = i.groupBy("story").agg(F.min("id").alias("representative"))
    return ledger.without_items(i, s, i.where("id % 4 = 0").select("id"))[1]


@query("""select c_custkey, case when c_custkey % 9 = 0 then 'missing' when c_custkey % 9 = 1 then 'different' end as problem from customer where c_custkey % 9 < 2 union all select -1, 'extra'""")
def copy_differences(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    copy = c.where("c_custkey % 9 > 0").withColumn("c_name", F.when(F.col("c_custkey") % 9 == 1, F.lit(None)).otherwise(F.col("c_name")))
    extra = spark.createDataFrame([(-1, "x", "y")], c.schema)
    return ledger.copy_differences(c, copy.unionByName(extra), "c_custkey", ["c_name", "c_mktsegment"])


@query(r"select c_custkey, sha256('=' || c_name || chr(31) || '=' || c_mktsegment || chr(31) || '-') as digest from customer")
def row_digests(spark, d):
    c = table(spark, d, "customer").withColumn("none", F.lit(None).cast("string"))
    return ledger.row_digests(c, "c_custkey", ["c_name", "c_mktsegment", "none"])


_SHORT = """
k as (select label as frame, list(x order by i) as centroid, case when label % 2 = 0 then 0.35 end as threshold from (select label, i, avg(x) as x from (select label, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2) group by 1),
s as (select article, frame, case when known then c end as score from (select vec_id as article, vec_id % 10 > 0 as known, frame, threshold, list_cosine_similarity(cast(embedding as double[]), centroid) as c from embeddings, k) where not known or c >= greatest(coalesce(threshold, 0.3), 0.3))"""


def _shortlist(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("article"), F.when(F.col("vec_id") % 10 > 0, F.col("embedding")).alias("vector"))
    k = _centroids(spark, d).select(F.col("label").alias("frame"), "centroid", F.when(F.col("label") % 2 == 0, 0.35).alias("threshold"))
    return ledger.shortlists(a, k)


@query(f"with {_SHORT} select article, frame, round(coalesce(score, -1), 4) as score from s")
def frame_shortlists(spark, d):
    return _shortlist(spark, d).select("article", "frame", F.round(F.coalesce("score", F.lit(-1.0)), 4).alias("score"))


@query(f"""with {_SHORT} select article, frame, cast(20 + article % 7 * 10 as int) as confidence from s where 20 + article % 7 * 10 >= 40 and article % 11 > 0 and article % 3 > 0""")
def frame_matches(spark, d):
    s = _shortlist(spark, d)
    i = F.col("article")
    v = s.select("article", "frame", (20 + i % 7 * 10).cast("int").alias("confidence"), F.when(i % 3 > 0, "Word, of it").otherwise("not there").alias("snippet"), F.when(i % 11 == 0, False).alias("keep"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("article"), F.lit("a WORD of it!").alias("body"))
    return ledger.matched(s, v, b).select("article", "frame", "confidence")


@query("""
with o as (select distinct event_id // 3 as article, event_type as frame from events where event_id % 2 = 0), n as (select distinct event_id // 3 as article, event_type as frame from events where event_id % 3 = 0)
select frame, count(case when o.article is not null and n.article is not null then 1 end) as kept, count(case when o.article is null then 1 end) as added, count(case when n.article is null then 1 end) as dropped from o full join n using (article, frame) group by 1""")
def rematch_report(spark, d):
    e = _e(spark, d).select(F.floor(F.col("event_id") / 3).alias("article"), F.col("event_type").alias("frame"), "event_id")
    return ledger.rematch_report(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"))


@query("""select c_custkey, c_custkey as entity_id, cast(case c_custkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 4 end as int) as way from customer""")
def canonical_names(spark, d):
    """Every way to an entity: its name, an alias, its district, its name with a title, and with a nickname."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    entities = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Robert Roe"), k).alias("name"), F.array(F.concat(F.lit("The Roe "), k)).alias("aliases"), F.concat(F.lit("PA-"), k).alias("district"), F.lit(1).alias("mention_count"))
    asked = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" robert ROE"), k)).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("the roe "), k)).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("PA "), k)).when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("Sen. Robert Roe"), k)).otherwise(F.concat(F.lit("Bob Roe"), k))
    return ledger.canonical(c.select("c_custkey", asked.alias("name")), "name", entities, {"bob": "robert"}).select("c_custkey", "entity_id", "way")


@query("""
with v as (select event_id, user_id as key, ts as t0 from events where event_type = 'error'), s as (select user_id as key, ts, value from events where event_type = 'view' and value is not null),
b as (select event_id, arg_min(value, (abs(epoch_us(ts) - epoch_us(t0)), ts)) as b from v join s using (key) where abs(epoch_us(ts) - epoch_us(t0)) <= 64800000000 group by 1),
a as (select event_id, arg_min(value, (abs(epoch_us(ts) - epoch_us(t0) - 172800000000), ts)) as a from v join s using (key) where abs(epoch_us(ts) - epoch_us(t0) - 172800000000) <= 86400000000 group by 1)
select event_id, round(coalesce(a - b, -999), 4) as delta from v left join a using (event_id) left join b using (event_id)""")
def event_study(spark, d):
    e = _e(spark, d)
    v = e.where("event_type = 'error'").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"))
    s = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", "value")
    return ledger.event_study(v, s).select("event_id", F.round(F.coalesce("delta", F.lit(-999.0)), 4).alias("delta"))


@query("select c_custkey, c_name, r as rank from customer join (values (7, 1), (3, 2), (11, 3), (2, 4)) v(k, r) on c_custkey = k")
def search_order(spark, d):
    return ledger.as_ranked(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", [7, 3, 11, 2])


@query("""select event_type, string_agg(v, ',' order by d) as points from (select event_type, strftime(ts, '%Y-%m-%d') as d, cast(max(event_id) as varchar) as v from events where value <> 0 group by 1, 2) group by 1""")
def tone_history(spark, d):
    n = _e(spark, d).withColumn("day", _day("ts")).where("value <> 0").groupBy("event_type", "day").agg(F.max("event_id").cast("string").alias("v"))
    return ledger.series_of(n, "event_type", "day", "v").select("event_type", F.array_join(F.transform("points", lambda p: p["value"]), ",").alias("points"))


@query("""select user_id, count(*) as shown, cast(arg_max(event_id, (ts, event_id)) as bigint) as latest from events where value between 20 and 80 group by 1""")
def market_view(spark, d):
    """A market's history without its suspect samples."""
    e = _e(spark, d).select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    out = ledger.series_of(e, "user_id", "at", "event_id", ~F.col("value").between(20, 80))
    return out.select("user_id", F.size("points").cast("long").alias("shown"), F.element_at("points", -1)["value"].alias("latest"))


@query("""
with n as (select 'spike' as kind, event_id as id, ts as t from events where value > 95 union all select 'error', event_id, ts from events where event_type = 'error' union all select 'signup', event_id, ts from events where event_type = 'signup' union all
 select 'order', o_orderkey, o_orderdate from orders where o_totalprice > 300000 union all select 'urgent', o_orderkey, o_orderdate from orders where o_orderpriority = '1-URGENT' union all select 'open', o_orderkey, o_orderdate from orders where o_orderstatus = 'O')
select kind, cast(id as varchar) as id from n where not (kind in ('spike', 'order') and id % 3 = 0) order by t desc, kind, cast(id as varchar) limit 60""")
def notifications(spark, d):
    e, o = _e(spark, d), table(spark, d, "orders")
    of_e, of_o = (lambda x: x.select(F.col("event_id").alias("id"), F.col("ts").alias("at"))), (lambda x: x.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")))
    kinds = {"spike": of_e(e.where("value > 95")), "error": of_e(e.where("event_type = 'error'")), "signup": of_e(e.where("event_type = 'signup'")), "order": of_o(o.where("o_totalprice > 300000")), "urgent": of_o(o.where("o_orderpriority = '1-URGENT'")), "open": of_o(o.where("o_orderstatus = 'O'"))}
    off = kinds["spike"].select(F.lit("spike").alias("kind"), "id").unionByName(kinds["order"].select(F.lit("order").alias("kind"), "id")).where("id % 3 = 0")
    return ledger.notifications(kinds, off.select("kind", F.col("id").cast("string").alias("id")), 60).select("kind", "id")


@query(f"""
with p as (select user_id, count(distinct case when ts >= {NOW} - interval 7 day then event_id end) as this_week, count(distinct case when ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day then event_id end) as last_week from events group by 1)
select user_id, this_week - last_week as delta from p where this_week + last_week > 0 order by abs(this_week - last_week) desc, user_id limit 6""")
def pulse_moves(spark, d):
    e = _e(spark, d)
    return ledger.moved_frames(counts.pulse(e, e, "user_id", "event_id", "ts", _as_of(spark, d))).select("user_id", "delta")


@query("""select o_orderstatus as label, count(*) as rows, count(case when not (o_totalprice > 100000) then 1 end) as small, count(case when o_orderpriority <> '1-URGENT' then 1 end) as calm from orders group by 1""")
def claim_audit(spark, d):
    o = table(spark, d, "orders").withColumn("label", F.col("o_orderstatus"))
    return ledger.claim_audit(o, {"small": F.col("o_totalprice") > 100000, "calm": F.col("o_orderpriority") == "1-URGENT"}, "label")


@query(r"""
with w(word) as (values ('license'), ('version'), ('the')) select word, count(case when n > 0 then 1 end) as docs, cast(sum(n) as bigint) as hits from (select word, len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')) as n from documents, w) group by 1""")
def keyword_frequencies(spark, d):
    return ledger.keyword_frequencies(table(spark, d, "documents"), "text", ["license", "version", "the"])


@query("""select o_custkey, string_agg(o_orderkey || ': ' || o_orderpriority, chr(10) order by o_totalprice desc, o_orderkey) as text from (select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3) group by 1""")
def issue_snapshots(spark, d):
    o = table(spark, d, "orders")
    return ledger.snapshot_text(o, "o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderpriority"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(r"select case when contains(url, 'example.org') then 'org' else 'other' end as platform, count(*) as filled from pages where page_id % 2 = 0 group by 1")
def platform_backfill(spark, d):
    p = table(spark, d, "pages").withColumn("platform", F.when(F.col("page_id") % 2 > 0, "known"))
    return ledger.filled(p, "platform", F.when(F.contains("url", F.lit("example.org")), "org").otherwise("other"))[1]


@query()
def sampled_diff(spark, d):
    """A deep comparison over a hash share of keys: sampling is its feature, and the hash is Spark's, so no SQL."""
    c = table(spark, d, "customer")
    return ledger.sampled_diff(c, c.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(F.col("c_name"))), "c_custkey", ["c_name"])


@query("""select event_type as frame, coalesce(case when event_id % 4 > 0 then user_id end, -1) as story, max(value) as confidence, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from events group by 1, 2""")
def insert_select(spark, d):
    e = _e(spark, d)
    i = e.select(F.col("event_id").alias("item"), F.when(F.col("event_id") % 4 > 0, F.col("user_id")).alias("story"), F.col("value").alias("confidence"), "ts")
    out = ledger.backfilled(i, e.select(F.col("event_id").alias("item"), F.col("event_type").alias("frame")), F.lit(-1))
    return out.select("frame", "story", "confidence", _day("first_seen").alias("first_seen"), _day("last_seen").alias("last_seen"))


@query("""
with s as (select e.vec_id, e.label, list_cosine_similarity(cast(e.embedding as double[]), k.v) as s, e.label = k.label as positive from embeddings e, (select label, list(x order by i) as v from (select label, i, avg(x) as x from (select label, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2) group by 1) k), t as (select unnest(range(0, 60)) / 100.0 as threshold)
select cast(threshold as double) as threshold, count(case when positive and s >= threshold then 1 end) as tp, count(case when not positive and s >= threshold then 1 end) as fp, count(case when positive and s < threshold then 1 end) as fn, round(count(case when positive and s >= threshold then 1 end) / greatest(count(case when positive then 1 end), 1), 4) as recall from s, t group by 1""")
def gate_calibration(spark, d):
    """Sixty thresholds over the similarities of all articles and frames, in one pass."""
    from tessera.functions import vectors

    e, k = table(spark, d, "embeddings"), _centroids(spark, d).withColumnRenamed("label", "frame")
    s = e.crossJoin(k).select(vectors.cosine(F.col("embedding"), F.col("centroid")).alias("s"), (F.col("label") == F.col("frame")).alias("positive"))
    return review.threshold_sweep(s, "s", "positive", [i / 100 for i in range(60)])


@query(r"""
select doc_id, cast(greatest(0, least(100, 30 + case when doc_id % 2 = 0 then 15 else 0 end + case when source is not null and source <> '' then 10 else 0 end + case when length(text) > 500 then 10 else 0 end + case when length(text) > 1500 then 5 else 0 end + case when regexp_matches(text, '\d') then 15 else 0 end
  + case when regexp_matches(text, '(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b') then 10 else 0 end + case doc_id % 4 when 0 then 15 when 1 then 5 when 2 then -5 else 0 end - case doc_id % 3 when 0 then 35 when 1 then 15 else 0 end)) as int) as score from documents where text is not null""")
def evidence_scores(spark, d):
    s = scores.evidence(F.when(F.col("doc_id") % 2 == 0, "http://x"), F.col("source"), F.col("text"), _pick("doc_id", "public_record", "news", "social", "note"), _pick("doc_id", "poor", "mixed", "good"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", s.alias("score"))


@query("""
with u as (select user_id, count(*) as n from events group by 1), p as (select *, n % 7 as l3, n % 20 as l14, (n % 7 / 3.0) / nullif(n % 20 / 14.0, 0) as r from u)
select user_id, round(case user_id % 4 when 0 then 40 when 1 then 20 when 2 then 5 else 0 end + case when l14 < 5 then 0 when r >= 3 then 25 when r >= 2 then 18 when r >= 1.5 then 10 else 0 end + case user_id % 5 when 0 then 15 when 1 then 12 when 2 then 8 else 0 end
  + least(n % 5 * 6.0 + n % 3 * 3.0 + n % 11 * 1.5, 30) + least(n % 8 * 2, 14) + case user_id % 6 when 0 then 20 when 1 then 18 when 2 then 15 when 3 then 8 else 0 end - case when n % 7 > 2 then least((n % 7 - 2) * 8, 24) else 0 end, 4) as score from p""")
def featured_scores(spark, d):
    g = _e(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    s = scores.featured_score(_pick("user_id", "high", "medium", "low", None), n % 7, n % 20, _pick("user_id", "emerging", "resurfacing", "spreading", "active", "fading"), {"national": n % 5, "regional": n % 3, "local": n % 11}, n % 8, _pick("user_id", "viral", "missing_coverage", "amplified", "elite_only", "stable", None), n % 7)
    return g.select("user_id", F.round(s, 4).alias("score"))


@query(r"select page_id from pages where url like 'https://www.%'")
def prefix_filter(spark, d):
    return table(spark, d, "pages").where(F.col("url").startswith("https://www.")).select("page_id")


@query("""select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal between -500 and 4000 and c_nationkey between 3 and 12""")
def places_in_box(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"), F.col("c_acctbal").alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    box = spark.createDataFrame([(3.0, -500.0, 12.0, 4000.0)], "west double, south double, east double, north double")
    return feeds.places_within(p, box, "BUILDING").select("c_custkey")


@query("select o_orderkey, o_orderpriority from orders where o_custkey = (select min(o_custkey) from orders) and trim(coalesce(o_orderpriority, '')) <> '' order by o_orderdate desc, o_orderkey limit 50")
def opponent_feed(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_custkey")).first()[0]
    return o.where((F.col("o_custkey") == first) & (F.trim(F.coalesce("o_orderpriority", F.lit(""))) != "")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' or o_orderstatus is null")
def verdict_list(spark, d):
    """Verdicts without the dismissed ones; an unknown status is shown."""
    return table(spark, d, "orders").where(F.coalesce(F.col("o_orderstatus") != "P", F.lit(True))).select("o_orderkey", "o_orderstatus")


@query(r"""select h as domain, min(page_id) as outlet from (select page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') as h from pages where page_id % 2 = 0 or page_id % 3 = 0) where h <> '' group by 1""")
def local_outlets(spark, d):
    """A catalogue's outlets of a district or its state, one a domain."""
    from tessera.functions.text import domain

    p = table(spark, d, "pages").where("page_id % 2 = 0 or page_id % 3 = 0").select(domain(F.col("url")).alias("domain"), "page_id")
    return p.where("domain is not null").groupBy("domain").agg(F.min("page_id").alias("outlet"))
