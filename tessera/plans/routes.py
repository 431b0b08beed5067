"""More result sets and maintenance jobs on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import selection, series, writes
from tessera.plans.media import NOW, _as_of, _day, _events
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select url_host, count(*) as pages, min(page_id) as first_page, cast(avg(try_cast(regexp_extract(url, '/(\\d+)', 1) as bigint)) as bigint) as mean_number from
(select *, split_part(split_part(url, '://', 2), '/', 1) as url_host from pages where url like '%example%') group by 1""")
def artlist_by_host(spark, d):
    p = table(spark, d, "pages").where(F.col("url").like("%example%"))
    host = F.try_element_at(F.split(F.try_element_at(F.split("url", "://"), F.lit(2)), "/"), F.lit(1))
    number = F.regexp_extract("url", r"/(\d+)", 1).try_cast("bigint")
    return p.groupBy(host.alias("url_host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.bround(F.avg(number), 0).cast("bigint").alias("mean_number"))


@query("select event_type, strftime(cast(ts as date), '%Y-%m-%d') as day, arg_max(event_id, (ts, event_id)) as last_event from events where value <> 0 group by 1, 2")
def tone_last_of_day(spark, d):
    e = _events(spark, d).where("value <> 0")
    return e.groupBy("event_type", _day("ts").alias("day")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("select user_id, strftime(day, '%Y-%m-%d') as day from (select distinct user_id, cast(ts as date) as day from events where event_type = 'view' except select user_id, cast(ts as date) from events where event_type = 'error')")
def skip_existing(spark, d):
    e = _events(spark, d).withColumn("day", _day("ts"))
    return e.where("event_type = 'view'").select("user_id", "day").distinct().join(e.where("event_type = 'error'").select("user_id", "day"), ["user_id", "day"], "left_anti")


@query(f"select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events where ts >= {NOW} - interval 7 day group by 1, 2")
def cached_results(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    out = selection.within_ttl(e.select("user_id", "event_type", "ts", "event_id"), "ts", _as_of(spark, d), 7, ["user_id", "event_type"])
    return out.select("user_id", "event_type", "event_id")


@query("""
with s as (select user_id, max(case when event_type = 'error' then event_id end) as detected_at, max(case when event_type = 'purchase' then event_id end) as r from events where value < 50 group by 1),
st as (select user_id, detected_at, case when r > detected_at then r end as resolved_at from s where detected_at is not null),
g as (select user_id, max(event_type = 'error' and value > 60) as firing, max(event_type = 'purchase') as recovered from events where value >= 50 group by 1)
select user_id, detected_at, coalesce(resolved_at_, -1) as resolved_at from (select user_id, case when firing then 99999 else detected_at end as detected_at, case when firing then null when detected_at is not null and resolved_at is null and recovered then 99999 else resolved_at end as resolved_at_
from st full join g using (user_id) where (case when firing then 99999 else detected_at end) is not null)""")
def alert_episodes(spark, d):
    e = _events(spark, d)
    of = lambda k: F.max(F.when(F.col("event_type") == k, F.col("event_id")))
    s = e.where("value < 50").groupBy("user_id").agg(of("error").alias("detected_at"), of("purchase").alias("r")).where("detected_at is not null")
    state = s.select("user_id", "detected_at", F.when(F.col("r") > F.col("detected_at"), F.col("r")).alias("resolved_at"))
    g = e.where("value >= 50").groupBy("user_id").agg(F.max((F.col("event_type") == "error") & (F.col("value") > 60)).alias("firing"), F.max(F.col("event_type") == "purchase").alias("recovered"))
    return selection.episodes(state, g, "user_id", F.lit(99999).cast("long")).na.fill(-1, ["resolved_at"])


@query("select o_orderkey, coalesce(case when c_custkey is not null then o_custkey end, -1) as customer from orders left join (select c_custkey from customer where c_acctbal > 0) on c_custkey = o_custkey")
def gc_set_null(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    o = table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce(F.when(F.col("c_custkey").isNotNull(), F.col("o_custkey")), F.lit(-1)).alias("customer"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascading_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("select p_name, p_type, count(*) as shared from (select p_name, unnest(string_split(lower(p_name), ' ')) as w from (select distinct p_name from part)) n join (select p_type, unnest(string_split(lower(p_type), ' ')) as w from (select distinct p_type from part)) t using (w) group by 1, 2")
def keyword_overlap(spark, d):
    p = table(spark, d, "part")
    return selection.keyword_overlap(p.select("p_name").distinct(), "p_name", F.split(F.lower("p_name"), " "), p.select("p_type").distinct(), "p_type", F.split(F.lower("p_type"), " "))


@query("select event_id, coalesce(lag(event_id) over w, -1) as before1, coalesce(lag(event_id, 2) over w, -1) as before2 from events window w as (partition by user_id order by ts, event_id)")
def previous_two(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select("event_id", F.lag("event_id").over(w).alias("before1"), F.lag("event_id", 2).over(w).alias("before2")).na.fill(-1)


@query("select c_custkey from customer, (select min(s_acctbal) as a, max(s_acctbal) as b from supplier where s_nationkey < 5) where c_acctbal between a and b and c_nationkey < 10")
def bounding_box(spark, d):
    box = table(spark, d, "supplier").where("s_nationkey < 5").agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
    return table(spark, d, "customer").where("c_nationkey < 10").join(F.broadcast(box)).where("c_acctbal between a and b").select("c_custkey")


@query("select event_type, count(distinct coalesce(cast(nullif(user_id % 6, 0) as varchar), 'source-' || event_id)) as stories from events group by 1")
def issue_clusters(spark, d):
    story = F.coalesce(F.nullif(F.col("user_id") % 6, F.lit(0)).cast("string"), F.concat(F.lit("source-"), F.col("event_id").cast("string")))
    return _events(spark, d).groupBy("event_type").agg(F.countDistinct(story).alias("stories"))


@query("select user_id, count(*) as articles, string_agg(distinct event_type, ',' order by event_type) as outlets from events group by 1 having count(*) >= 50 order by articles desc, user_id limit 20")
def author_frequency(spark, d):
    g = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("articles"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("outlets"))
    return g.where("articles >= 50").orderBy(F.desc("articles"), "user_id").limit(20)


@query(f"""
with x as (select user_id, cast(date_diff('day', cast(ts as date), cast({NOW} as date)) as int) as age from events)
select user_id, count(case when age between 1 and 3 then 1 end) as last3, count(case when age between 1 and 7 then 1 end) as last7, count(case when age between 1 and 14 then 1 end) as last14, count(case when age between 8 and 28 then 1 end) as prior21 from x group by 1""")
def trailing_slices(spark, d):
    age = F.datediff(_as_of(spark, d), F.col("ts"))
    return _events(spark, d).groupBy("user_id").agg(*[F.count_if(age.between(a, b)).alias(n) for n, a, b in (("last3", 1, 3), ("last7", 1, 7), ("last14", 1, 14), ("prior21", 8, 28))])


@query("select user_id, round(least(n * 0.5, 20) + least(u * 3.0, 12) + least(coalesce(v, 0) * 0.1, 8) - case when n > 80 then 5 else 0 end, 4) as score from (select user_id, count(*) as n, count(distinct event_type) as u, max(value) as v from events group by 1)")
def multi_objective(spark, d):
    g = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("u"), F.max("value").alias("v"))
    terms = {"volume": (F.col("n"), 0.5, 20.0), "breadth": (F.col("u"), 3.0, 12.0), "peak": (F.col("v"), 0.1, 8.0)}
    return g.select("user_id", F.round(selection.capped_sum(terms, F.when(F.col("n") > 80, 5).otherwise(0)), 4).alias("score"))


@query("select kind, id from (select 'spike' as kind, event_id as id from events where value > 99 union all select 'error', event_id from events where event_type = 'error' and value > 95 union all select 'order', o_orderkey from orders where o_totalprice > 400000) where id % 5 <> 0")
def alert_union(spark, d):
    e, o = _events(spark, d), table(spark, d, "orders")
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    rows = kind(e.where("value > 99"), "spike", "event_id").unionByName(kind(e.where("event_type = 'error' and value > 95"), "error", "event_id")).unionByName(kind(o.where("o_totalprice > 400000"), "order", "o_orderkey"))
    dismissed = e.select(F.col("event_id").alias("id")).unionByName(o.select(F.col("o_orderkey").alias("id"))).where("id % 5 = 0").distinct()
    return rows.join(dismissed, "id", "left_anti").select("kind", "id")


@query("select c_custkey, sha1(c_name || '|||' || c_mktsegment) as content_hash from customer")
def content_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha1(F.concat_ws("|||", "c_name", "c_mktsegment")).alias("content_hash"))


@query(f"select user_id, count(distinct cast(ts as date)) as active_days from events where ts >= {NOW} - interval 7 day and ts < {NOW} group by 1")
def active_days(spark, d):
    now = _as_of(spark, d)
    e = _events(spark, d).where((F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < now))
    return e.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("active_days"))


@query("""select o_orderkey, 'o_orderpriority' as "column", o_orderpriority as before, case when o_orderkey % 3 = 0 then null else o_orderpriority || '!' end as after from orders where o_orderkey % 3 = 0 or o_orderkey % 3 = 1""")
def reanalysis_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey") % 3
    new = o.withColumn("o_orderpriority", F.when(k == 0, F.lit(None)).when(k == 1, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")))
    return writes.changed(o, new, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query("select user_id, count(*) as mention_count, count(distinct event_type) as source_count, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from events where ts >= timestamp '2024-01-01' group by 1")
def recompute_counters(spark, d):
    e = _events(spark, d).where(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.count("*").alias("mention_count"), F.countDistinct("event_type").alias("source_count"), _day(F.min("ts")).alias("first_seen"), _day(F.max("ts")).alias("last_seen"))


@query("select actor, n from (select actor, count(*) as n from (select unnest([event_type, 'u' || (user_id % 9), case when value > 50 then 'big' end]) as actor from events) where actor is not null group by 1) order by n desc, actor limit 5")
def top_actors(spark, d):
    names = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")), F.when(F.col("value") > 50, "big"))
    a = _events(spark, d).select(F.explode(names).alias("actor")).where("actor is not null")
    return a.groupBy("actor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(5)


@query("select dom, n from (select array_to_string(list_slice(string_split(split_part(split_part(url, '://', 2), '/', 1), '.'), -2, -1), '.') as dom, count(*) as n from pages group by 1) where n >= 3 and dom <> 'example.org'")
def feed_discovery(spark, d):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    dom = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    blocked = spark.createDataFrame([("example.org",)], "dom string")
    return table(spark, d, "pages").groupBy(dom.alias("dom")).agg(F.count("*").alias("n")).where("n >= 3").join(F.broadcast(blocked), "dom", "left_anti")


@query("""select count(distinct c_custkey) as customers, (select count(*) from orders) as orders, (select count(*) from supplier where s_acctbal > 0) as suppliers, (select count(*) from events where event_type = 'signup') as signups from customer""")
def setup_checklist(spark, d):
    parts = [table(spark, d, "customer").agg(F.countDistinct("c_custkey").alias("customers")), table(spark, d, "orders").agg(F.count("*").alias("orders")), table(spark, d, "supplier").where("s_acctbal > 0").agg(F.count("*").alias("suppliers")), _events(spark, d).where("event_type = 'signup'").agg(F.count("*").alias("signups"))]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out


@query("select user_id % 30 as key, arg_max(event_type, (ts, event_id)) as text from events group by 1")
def override_upsert(spark, d):
    return _events(spark, d).groupBy((F.col("user_id") % 30).alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text"))


@query("select label, count(*) as size, round(avg(s), 4) as mean_to_centroid from (select e.label, list_cosine_similarity(cast(embedding as double[]), v) as s from embeddings e join (select label, list(x order by i) as v from (select label, i, avg(x) as x from (select label, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2) group by 1) k on e.label = k.label) group by 1")
def cluster_metrics(spark, d):
    from tessera.functions import vectors
    from tessera.plans.media import _centroids

    s = table(spark, d, "embeddings").join(F.broadcast(_centroids(spark, d)), "label")
    return s.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("centroid"))), 4).alias("mean_to_centroid"))


@query("""select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.t, -1) as valid_from, coalesce(b.t, -1) as valid_to from (select user_id, min(event_id) as t from events where event_type = 'signup' group by 1) a full join (select user_id, max(event_id) as t from events where event_type = 'error' and value > 50 group by 1) b on a.user_id = b.user_id""")
def temporal_validity(spark, d):
    e = _events(spark, d)
    a = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("valid_from"))
    return a.join(e.where("event_type = 'error' and value > 50").groupBy("user_id").agg(F.max("event_id").alias("valid_to")), "user_id", "full").na.fill(-1)


@query()
def table_digest(spark, d):
    return writes.table_digest(table(spark, d, "orders"))


@query()
def featured_frames(spark, d):
    """Only rows that the greedy choice can reach come to the driver: the first of each owner and stage, of the pinned, and of all."""
    g = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    g = g.select("user_id", "n", (F.col("user_id") % 3).alias("owner"), (F.col("user_id") % 5).alias("stage"), (F.col("user_id") % 50 == 0).alias("pinned"), (F.col("user_id") % 7 != 0).alias("live"))
    rows = selection.featured([r.asDict() for r in selection.reachable(g, [F.desc("n"), F.col("user_id")]).collect()])
    return spark.createDataFrame([(i + 1, r["user_id"]) for i, r in enumerate(rows)], "rank int, user_id long")


@query("select event_id, rank from (select event_id, cast(row_number() over (partition by event_type order by value desc nulls last, event_id) as int) as rank from events) where rank <= 6")
def pulse_block(spark, d):
    return series.first_of(_events(spark, d), ["event_type"], [F.desc_nulls_last("value"), F.col("event_id")], 6).select("event_id", "rank")
