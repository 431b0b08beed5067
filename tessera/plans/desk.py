"""Frames, entities, audits and upkeep on the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import claims, density, frames, incremental, layout, review, stories, upkeep
from tessera.plans.media import NOW, _as_of, _day
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


_TIERS = ["national", "regional", "local"]
_LEAST = {"emerging": 3, "resurfacing": 10, "mainstream": 20, "floor": 2, "baseline": 1}


def _items(spark, d):
    tier = F.element_at(F.array(*[F.lit(t) for t in _TIERS]), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_type").alias("frame"), F.col("user_id").alias("story"), (F.col("event_id") % 37).alias("outlet"), tier.alias("tier"), (F.col("user_id") % 4 + 0.5).alias("weight"), "ts", F.col("event_id").alias("item"), "value")


_ITEMS = "i as (select event_type as frame, user_id as story, event_id % 37 as outlet, user_id % 3 as tier, cast(user_id % 4 + 0.5 as decimal(20,6)) as weight, ts, event_id as item, value from events)"
_W, _L, _P = f"ts >= {NOW} - interval 7 day", f"ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day", f"ts >= {NOW} - interval 28 day and ts < {NOW} - interval 7 day"
_AGO = f"date_diff('day', cast(ts as date), cast({NOW} as date))"


@query(f"""
with {_ITEMS}, g as (select frame, count(*) as articles, count(distinct story) as total, count(distinct case when {_W} then story end) as this_week, count(distinct case when {_L} then story end) as last_week, count(distinct case when {_P} then story end) as p3,
  count(distinct case when {_W} then outlet end) as outlets, count(distinct case when {_L} then outlet end) as outlets_last_week, count(distinct case when {_W} then cast(ts as date) end) as active_days,
  cast(round(coalesce(sum(case when {_W} then weight end), 0), 1) as double) as reach, count(distinct case when tier = 0 then outlet end) as national, count(distinct case when tier = 1 then outlet end) as regional, count(distinct case when tier = 2 then outlet end) as local, min({_AGO}) as days_since,
  {" || ',' || ".join(f"count(case when {_AGO} = {n} then 1 end)" for n in range(14, 0, -1))} as sparkline from i group by 1),
s as (select frame, story, count(*) as n, min(ts) as a, max(ts) as b from i group by 1, 2),
k as (select frame, arg_min(story, (a, story)) as first_story, arg_min(story, (-n, story)) as peak_story, arg_min(story, (-epoch_us(b), story)) as latest_story from s group by 1),
q as (select *, (select list(total order by total) from g) as t, (select list(this_week order by this_week) from g) as w from g join k using (frame)),
z as (select *, greatest(3, t[cast(floor((len(t) - 1) * 0.25) as int) + 1]) as em, greatest(10, t[cast(floor((len(t) - 1) * 0.25) as int) + 1]) as re, greatest(20, t[cast(floor((len(t) - 1) * 0.5) as int) + 1]) as ma, greatest(2, floor(w[cast(floor((len(w) - 1) * 0.5) as int) + 1] / 2)) as fl, p3 / 3.0 as base from q)
select frame, articles, total, this_week, last_week, outlets, outlets_last_week, active_days, reach, national, regional, local, sparkline, first_story, peak_story, latest_story,
  case when total = 0 or days_since is null or days_since > 14 then 'dormant' when total <= em then 'emerging' when total >= re and this_week >= greatest(2, floor(fl / 2)) and base = 0 then 'resurfacing' when this_week >= fl and base >= 1 and this_week >= base * 2 then 'spreading'
       when base >= 2 and this_week < base * 0.5 then 'fading' when total >= ma then 'mainstream' else 'active' end as stage, case when this_week > last_week then 'up' when this_week < last_week then 'down' else 'flat' end as trend from z""")
def frames_with_counts(spark, d):
    i = _items(spark, d)
    out = frames.with_counts(i, i.select("frame"), _as_of(spark, d), _TIERS, _LEAST)
    return out.withColumn("sparkline", F.array_join(F.col("sparkline").cast("array<string>"), ",")).drop("prior_three_weeks", "baseline_weekly", "days_since")


@query(f"""
with {_ITEMS}, c as (select frame, cast(unnest(generate_series(cast({NOW} - interval 20 day as timestamp), cast({NOW} - interval 1 day as timestamp), interval 1 day)) as date) as day from (select distinct frame from i)),
f as (select frame, a as day, count(*) as stories from (select frame, story, cast(min(ts) as date) as a from i group by 1, 2) group by 1, 2), r as (select frame, cast(ts as date) as day, sum(weight) as reach from i group by 1, 2)
select frame, strftime(day, '%Y-%m-%d') as day, coalesce(stories, 0) as stories, round(coalesce(cast(reach as double), 0), 1) as reach from c left join f using (frame, day) left join r using (frame, day)""")
def frame_timeseries(spark, d):
    return frames.timeseries(_items(spark, d), _as_of(spark, d), 20).withColumn("day", _day("day"))


@query(f"""
with {_ITEMS}, o as (select *, 'said ' || outlet as quote from i where frame = 'purchase'), g as (select story, count(*) as articles, count(distinct outlet) as outlets, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from o group by 1),
q as (select story, quote, row_number() over (partition by story order by length(quote) desc, quote) as r from (select distinct story, quote from o)) select g.*, (select string_agg(quote, '|' order by r) from q where q.story = g.story and r <= 3) as quotes from g""")
def frame_detail(spark, d):
    i = _items(spark, d).withColumn("quote", F.concat(F.lit("said "), F.col("outlet").cast("string")))
    out = frames.detail(i, F.lit("purchase"))
    return out.select("story", "articles", "outlets", _day("first_seen").alias("first_seen"), _day("last_seen").alias("last_seen"), F.array_join("quotes", "|").alias("quotes"))


@query(f"with {_ITEMS} select story % 10 as variant, frame, count(distinct item) as articles, strftime(min(ts), '%Y-%m-%d') as first, strftime(max(ts), '%Y-%m-%d') as last from i group by 1, 2")
def variant_articles(spark, d):
    i = _items(spark, d)
    out = frames.variant_articles(i.select((F.col("story") % 10).alias("variant"), "item"), i.select("item", "frame", "ts"))
    return out.select("variant", "frame", "articles", _day("first").alias("first"), _day("last").alias("last"))


@query(f"""
with {_ITEMS}, f as (select story as frame, count(distinct case when {_W} then outlet end) as o1, count(distinct case when {_P} then outlet end) as o3, count(case when {_W} then 1 end) as c1, count(case when {_P} then 1 end) as c3 from i group by 1),
v as (select frame, avg(v) as t from (select distinct story as frame, story % 5 as term from i where story % 4 > 0) join (values (0, 0.5), (1, 2.5), (2, 1.0), (3, 3.0)) x(term, v) using (term) group by 1)
select frame, coalesce(case when c1 + c3 < 5 then null when t is null then 'no_trend_signal' when o1 / greatest(o3 / 3.0, 1) >= 2 and t >= 2 then 'viral' when o1 / greatest(o3 / 3.0, 1) >= 2 then 'amplified' when c1 / greatest(c3 / 3.0, 1) >= 2 then 'elite_only' when t >= 2 then 'missing_coverage' else 'stable' end, '-') as signal from f left join v using (frame)""")
def momentum_job(spark, d):
    i, as_of, t = _items(spark, d), _as_of(spark, d), F.col("ts")
    w = t >= as_of - F.expr("INTERVAL 7 DAYS")
    p = (t >= as_of - F.expr("INTERVAL 28 DAYS")) & ~w
    f = i.groupBy(F.col("story").alias("frame")).agg(F.countDistinct(F.when(w, F.col("outlet"))).alias("outlets"), F.countDistinct(F.when(p, F.col("outlet"))).alias("outlets_prior"), F.count_if(w).alias("stories"), F.count_if(p).alias("stories_prior"))
    terms = i.select(F.col("story").alias("frame"), (F.col("story") % 5).alias("term")).where("frame % 4 > 0").distinct()
    interest = spark.createDataFrame([(0, 0.5), (1, 2.5), (2, 1.0), (3, 3.0)], "term long, velocity double")
    return frames.momentum(f, interest, terms).select("frame", F.coalesce("signal", F.lit("-")).alias("signal"))


@query("""
with s as (select 'top' as section, o_orderkey as k, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders union all select 'new', o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) from orders union all select 'urgent', o_orderkey, row_number() over (order by o_orderpriority, o_orderkey) from orders where o_orderstatus = 'O')
select section, cast(r as int) as rank, cast(k as varchar) as key from s where r <= 5""")
def morning_briefing(spark, d):
    """Sections of a briefing: each is ranked before it is cut, so no row is fetched to be filtered later."""
    o = table(spark, d, "orders")

    def first(rows, *order):
        top = rows.orderBy(*order).limit(5)  # top-k a partition, then of these: the window ranks five rows
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))

    return frames.bundle({"top": first(o, F.desc("o_totalprice"), "o_orderkey"), "new": first(o, F.desc("o_orderdate"), "o_orderkey"), "urgent": first(o.where("o_orderstatus = 'O'"), "o_orderpriority", "o_orderkey")}, "o_orderkey", "rank")


@query("""
with a as (select * from orders where o_orderkey = (select min(o_orderkey) from orders))
select o_orderkey, (select string_agg(l_linenumber, ',' order by l_linenumber) from lineitem where l_orderkey = o_orderkey) as lines, (select c_name from customer where c_custkey = o_custkey) as customer from a""")
def article_detail(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_orderkey")).first()[0]
    one = o.where(F.col("o_orderkey") == first).select("o_orderkey", "o_custkey")
    out = frames.article_detail(one, {"lines": (table(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber"))}, "o_orderkey")
    out = frames.article_detail(out, {"customer": (table(spark, d, "customer"), "c_custkey", F.col("c_name"))}, "o_custkey")
    return out.select("o_orderkey", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_join("customer", ",").alias("customer"))


@query("""
with r as (select distinct event_type as region, user_id as m from events where value >= 50), k as (select distinct 'L' || (user_id % 3) as label, user_id % 3 = 0 as edited, user_id as m from events),
b as (select region, label, edited, count(*) as n from r join k using (m) group by 1, 2, 3), j as (select region, label, edited, n / cast((select count(*) from r x where x.region = b.region) + (select count(*) from k y where y.label = b.label) - n as double) as j from b)
select region, coalesce((select label from j where j.region = e.region and j.j >= 0.3 order by not edited, -j.j, label limit 1), '-') as label from (select distinct region from r) e""")
def region_labels(spark, d):
    e = table(spark, d, "events")
    known = e.select(F.concat(F.lit("L"), (F.col("user_id") % 3).cast("string")).alias("label"), (F.col("user_id") % 3 == 0).alias("edited"), F.col("user_id").alias("member"))
    out = frames.region_labels(e.where("value >= 50").select(F.col("event_type").alias("region"), F.col("user_id").alias("member")), known, 0.3)
    return out.select("region", F.coalesce("label", F.lit("-")).alias("label"))


def _relations(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("s"), F.col("o_orderstatus").alias("p"), (F.col("o_orderkey") % 30 + 10).alias("o"), F.col("o_orderkey").alias("article"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("version"))


_REL = "r as (select o_custkey % 40 as s, o_orderstatus as p, o_orderkey % 30 + 10 as o, count(*) as weight from orders group by 1, 2, 3), n as (select s as id, sum(weight) as mentions from r group by 1)"


@query(f"with {_REL}, v as (select id from n where mentions >= 20 or id % 7 = 0) select s, p, o, weight from r where s in (select id from v) and o in (select id from v) and not (p = 'P' and s % 2 = 0)")
def entity_network(spark, d):
    r = _relations(spark, d).groupBy("s", "p", "o").agg(F.count("*").alias("weight"))
    n = r.groupBy(F.col("s").alias("id")).agg(F.sum("weight").alias("mentions")).withColumn("type", F.when(F.col("id") % 7 == 0, "event").otherwise("person"))
    return upkeep.network(n, r, r.where("p = 'P' and s % 2 = 0").select("s", "p", "o"), 20)[1]


@query(f"""select user_id as entity, count(distinct case when ts >= {NOW} - interval 7 day then event_id end) as this, count(distinct case when ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day then event_id end) as before, count(distinct event_id) as articles,
  count(distinct case when ts >= {NOW} - interval 7 day then event_id end) - count(distinct case when ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day then event_id end) as delta from events group by 1""")
def entity_profiles(spark, d):
    return upkeep.profile(_mentions(spark, d), _as_of(spark, d), 7)


def _mentions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("article"), "ts")


@query(f"""
with m as (select distinct case when e % 3 = 2 then e - 1 else e end as entity, article, ts from (select user_id as e, event_id // 4 as article, ts from events)), r as (select distinct article from m where entity in (0, 1)),
g as (select entity, count(distinct article) as raw, count(distinct case when article in (select article from r) then article end) as gated from m where ts >= {NOW} - interval 7 day group by 1)
select entity, raw as mentions, cast(-1 as double) as share from g where entity in (0, 1) union all (select entity, gated, round(gated / raw, 4) from g where entity not in (0, 1) and gated > 0 order by gated desc, entity limit 4)""")
def briefing_entities(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.floor(F.col("event_id") / 4).alias("article"), "ts")
    aliases = m.select("entity").distinct().where("entity % 3 = 2").select("entity", (F.col("entity") - 1).alias("canonical"))
    return upkeep.briefing_entities(m, aliases, [0, 1], _as_of(spark, d)).select("entity", "mentions", F.round(F.coalesce("share", F.lit(-1.0)), 4).alias("share"))


@query(f"""
with c as (select event_id as claim, event_type || ' of the matter at hand number ' || (event_id // 2) as quote, event_type as label, user_id as entity, case when user_id % 3 > 0 then user_id % 100 end as rel, ts from events),
s as (select claim, quote, round(case label when 'error' then 3 when 'purchase' then 2 end * ln(coalesce(rel, 50) + 1) / ln(101) * greatest(0.1, 1 - (epoch({NOW}) - floor(epoch(ts))) / 3600.0 / 48), 6) as score from c where ts >= {NOW} - interval 48 hour and label in ('error', 'purchase') and entity % 2 = 0)
select claim, score from (select claim, score, row_number() over (partition by lower(quote) order by score desc, claim) as r from s) where r = 1 order by score desc, claim limit 5""")
def overnight_changes(spark, d):
    e = table(spark, d, "events")
    quote = F.concat("event_type", F.lit(" of the matter at hand number "), F.floor(F.col("event_id") / 2).cast("string"))
    c = e.select(F.col("event_id").alias("claim"), quote.alias("quote"), F.col("event_type").alias("label"), F.col("user_id").alias("entity"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 100).alias("reliability"), "ts")
    return upkeep.overnight(c, e.select(F.col("user_id").alias("entity")).where("entity % 2 = 0").distinct(), {"error": 3, "purchase": 2}, _as_of(spark, d))


@query("select o_orderpriority as version, count(*) as entries, count(distinct (o_custkey % 40, o_orderkey % 30)) as relations, o_orderpriority <> '1-URGENT' as stale from orders group by 1")
def drift_summary(spark, d):
    e = _relations(spark, d).select(F.struct("s", F.col("article") % 30).alias("relation"), "article", "version")
    return upkeep.drift(e, "1-URGENT")


@query("""
with e as (select distinct o_custkey as rel, o_orderkey as article, o_orderpriority as v from orders), w as (select o_custkey as rel, count(*) as w from orders group by 1)
select article, sum(w) as weight from e join w using (rel) where rel not in (select rel from e where v = '1-URGENT') group by 1 order by weight desc, article limit 50""")
def stale_articles(spark, d):
    o = table(spark, d, "orders")
    w = o.groupBy(F.col("o_custkey").alias("relation")).agg(F.count("*").alias("weight"))
    return upkeep.stale_articles(o.select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("article"), F.col("o_orderpriority").alias("version")), w, "1-URGENT", 50)


@query(r"select h as handle, count(*) as posts, cast(0 as bigint) as relevant from (select distinct page_id, unnest(string_split(lower(url), '/')) as h from pages) where h in ('en', 'de', 'fr', 'es', 'xx') group by 1 having count(*) >= 3 and count(case when h = 'en' then 1 end) = 0")
def unproductive_handles(spark, d):
    handles = spark.createDataFrame([(h,) for h in ("en", "DE", "fr", "es", "xx")], "handle string")
    return upkeep.productivity(table(spark, d, "pages"), handles, 3, F.contains(F.lower("url"), F.lit("/en/")))


@query("""
with b as (select user_id as source, ts as t, value as own, 100 - value + event_id % 50 as other, event_id from events), x as (select source, t, arg_min([own, other], event_id % 3 <> 0) as v from b group by 1, 2),
y as (select source, t, v[1] as own, v[2] as other from x), w as (select *, own - lag(own) over (partition by source order by t) as up, lead(own) over (partition by source order by t) - own as down from y)
select source, count(*) as n, count(case when not (own + other between 80 and 120) or coalesce((up > 15 and down < -15) or (up < -15 and down > 15), false) then 1 end) as suspect from w group by 1""")
def snapshot_append(spark, d):
    """Snapshots of two sides appended to those kept, one a source and time, with the incoherent and the isolated ones flagged."""
    b = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("value").alias("own"), (100 - F.col("value") + F.col("event_id") % 50).alias("other"), "event_id")
    out = upkeep.samples(b.where("event_id % 3 = 0"), b.where("event_id % 3 <> 0"))
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if("suspect").alias("suspect"))


@query("""
with x as (select label as g, vec_id as k, cast(embedding as double[]) as v from embeddings) select l.k as a, r.k as b, round(1 - list_cosine_similarity(l.v, r.v), 4) as distance from x l join x r on l.g = r.g and l.k < r.k""")
def pair_distances(spark, d):
    return upkeep.pair_dataset(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 100).where("same").select("a", "b", "distance")


@query()
def greedy_variants(spark, d):
    return stories.greedy_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.3)


@query("select source as cluster, sum(n) as size, round(max(n) / sum(n), 4) as share from (select source, text, count(*) as n from documents where source is not null group by 1, 2) group by 1")
def wire_purity(spark, d):
    return upkeep.wire_purity(table(spark, d, "documents").where("source is not null").select(F.col("source").alias("cluster"), "text"), "cluster", "text")


@query("select lower(substr(p_name, 1, 4)) as key, arg_min(p_partkey, (-p_size, p_partkey)) as target, string_agg(p_partkey, ',' order by p_partkey) as members from part group by 1 having count(*) > 1")
def rule_groups(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("mentions"), "p_name")
    return upkeep.rule_groups(p, F.lower(F.substring("p_name", 1, 4))).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("select a, b, round(s, 4) as similarity from (select l.vec_id as a, r.vec_id as b, list_cosine_similarity(cast(l.embedding as double[]), cast(r.embedding as double[])) as s from embeddings l join embeddings r on l.label = r.label and l.vec_id < r.vec_id) where s >= 0.25")
def similar_entities(spark, d):
    return upkeep.similar_entities(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.25)


@query("""with r as (select distinct o_custkey % 40 as s, o_orderstatus as p, o_orderkey % 30 + 10 as o from orders) select s, p, o, s % 3 as party_s, o % 3 as party_o from r where p in ('F') and s % 3 <> o % 3""")
def partisan_guard(spark, d):
    r = _relations(spark, d).select("s", "p", "o").distinct()
    ids = spark.range(40).select("id", (F.col("id") % 3).alias("party"))
    return upkeep.partisan_guard(r, ids, ["F"]).select("s", "p", "o", "party_s", "party_o")


@query("""with l as (select l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')) select cast(0 as bigint) as nulls, count(*) as orphans, (select string_agg(l_orderkey, ',' order by l_orderkey) from (select l_orderkey from l order by 1 limit 5)) as samples from l""")
def reference_audit(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    out = upkeep.reference_audit(table(spark, d, "lineitem"), "l_orderkey", o, "o_orderkey", "l_orderkey")
    return out.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("""
with s as (select o_custkey as claim, o_orderkey as article, case when o_orderstatus = 'F' then 'supports' else 'refutes' end as stance, row_number() over (partition by o_custkey, o_orderstatus = 'F' order by o_orderdate desc, o_orderkey) as r from orders)
select c_custkey as claim, coalesce((select string_agg(article, ',' order by r) from s where claim = c_custkey and stance = 'supports' and r <= 3), '') as supports, coalesce((select string_agg(article, ',' order by r) from s where claim = c_custkey and stance = 'refutes' and r <= 3), '') as refutes,
  case when c_custkey % 5 = 0 then 'retracted' when c_custkey % 5 = 1 then 'active' else 'open' end as status from customer""")
def claim_views(spark, d):
    """Claims with their supports by stance, newest first, after retractions and reactivations."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("claim"), F.lit("open").alias("status"))
    ch = c.where("claim % 5 < 2").select("claim", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("retracted").alias("status")), F.struct(F.lit(2).alias("at"), F.when(F.col("claim") % 5 == 0, "retracted").otherwise("active").alias("status")))).alias("x")).select("claim", "x.*")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("claim"), F.col("o_orderkey").alias("article"), F.when(F.col("o_orderstatus") == "F", "supports").otherwise("refutes").alias("stance"), F.col("o_orderdate").alias("ts"))
    joined = lambda k: F.coalesce(F.array_join(F.col(k).cast("array<string>"), ","), F.lit("")).alias(k)
    return upkeep.claim_view(upkeep.with_status(c, ch), s, 3).select("claim", joined("supports"), joined("refutes"), "status")


@query("select event_id, case when user_id = 3 and event_id % 2 = 0 then 'merged' else case when event_id % 2 > 0 then event_type else '-' end end as frame from events")
def executed_merge(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 2 > 0, F.col("event_type")).alias("frame"))
    return upkeep.resolved_merge(e, F.col("user_id") == 3, F.lit("merged")).select("event_id", F.coalesce("frame", F.lit("-")).alias("frame"))


@query("""
with p as (select * from embeddings where vec_id % 25 = 0), s as (select p.vec_id as probe, e.vec_id, round(list_cosine_similarity(cast(p.embedding as double[]), cast(e.embedding as double[])), 6) as s from p join embeddings e on p.label = e.label and p.vec_id <> e.vec_id)
select probe, vec_id, cast(row_number() over (partition by probe order by s desc, vec_id) as int) as rank from s qualify row_number() over (partition by probe order by s desc, vec_id) <= 4""")
def past_decisions(spark, d):
    e = table(spark, d, "embeddings")
    return upkeep.nearest_past(e, e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("probe"), "label", "embedding"), "vec_id", "embedding", "label")


@query(r"""
with h as (select url, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') as host, page_id % 10 as a from pages), b as (select host, arg_min(url, (-a, url)) as url, max(a) as affinity from h where host <> '' group by 1)
select host, url, affinity from b order by affinity desc, url limit 20""")
def candidate_urls(spark, d):
    return upkeep.candidate_urls(table(spark, d, "pages"), ["blocked.example"], F.col("page_id") % 10, 20)


@query("select c_custkey, cast(30 + case when c_custkey % 2 = 0 then 10 else 0 end + least(c_custkey % 9 * 5, 25) as int) as points from customer")
def handle_scores(spark, d):
    said = F.when(F.col("c_custkey") % 2 == 0, "a customer of ours")
    s = upkeep.handle_score(F.col("c_name"), ["customer"], said, F.col("c_custkey") % 9)
    return table(spark, d, "customer").select("c_custkey", s.cast("int").alias("points"))


@query("""
select 'feed' as kind, url as name from (select distinct url from pages where page_id % 2 = 0 and url not in (select url from pages where page_id % 3 = 0)) union all
select 'reminder', name from (select distinct 'n' || (page_id % 7) as name from pages where page_id % 2 = 1) where name <> 'n1'""")
def applied_pack(spark, d):
    p = table(spark, d, "pages")
    pack = p.select(F.when(F.col("page_id") % 2 == 0, "feed").otherwise("reminder").alias("kind"), F.concat(F.lit("n"), (F.col("page_id") % 7).cast("string")).alias("name"), "url")
    f, r = upkeep.applied_pack(pack, p.where("page_id % 3 = 0").select("url"), spark.createDataFrame([("n1",)], "name string"))
    return f.select(F.lit("feed").alias("kind"), F.col("url").alias("name")).unionByName(r.select(F.lit("reminder").alias("kind"), "name"))


@query("select case when a.p is null then 'added' else 'removed' end as change, coalesce(a.p, b.p) as capability from (select distinct o_orderpriority as p from orders where o_orderstatus = 'P') a full join (select distinct p from (select o_orderpriority as p from orders where o_orderkey % 4 = 0 union select 'extra')) b on a.p = b.p where a.p is null or b.p is null")
def version_diff(spark, d):
    o = table(spark, d, "orders")
    v = o.where("o_orderstatus = 'P'").agg(F.collect_set("o_orderpriority").alias("capabilities")).withColumn("version", F.lit("1"))
    w = o.where("o_orderkey % 4 = 0").agg(F.array_union(F.collect_set("o_orderpriority"), F.array(F.lit("extra"))).alias("capabilities")).withColumn("version", F.lit("2"))
    return upkeep.capability_diff(v.unionByName(w), "1", "2")


@query("""
with i as (select page_id, url, case when page_id % 2 = 0 then 'short' else html end as body from pages), p as (select url, arg_max(html, (length(html), html)) as t from pages group by 1)
select page_id as id, md5(case when coalesce(length(body), 0) < 100 and length(t) > coalesce(length(body), 0) then t else body end) as digest, coalesce(coalesce(length(body), 0) < 100 and length(t) > coalesce(length(body), 0), false) as recovered from i left join p using (url)""")
def recovered_bodies(spark, d):
    p = table(spark, d, "pages")
    items = p.select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 2 == 0, "short").otherwise(F.col("html")).alias("body"))
    return upkeep.stub_recovery(items, p.select("url", F.col("html").alias("text")), 100).select("id", F.md5("body").alias("digest"), "recovered")


@query()
def link_candidates(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("page"), "html", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return upkeep.link_candidates(p, F.lit(True), "title", 0.0)


@query()
def duplicate_pairs(spark, d):
    """Stubs are made of documents' first lines; the ratio has no SQL, tests compare with examples."""
    docs = table(spark, d, "documents")
    title = F.substring_index("text", "\n", 1)
    stubs = docs.select((-F.col("doc_id") - 1).alias("id"), title.alias("title"), F.lit("stub").alias("body"))
    return stories.duplicate_pairs(docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("body")).unionByName(stubs), F.lit(True))


def _articles(spark, d):
    start = F.lit("2024-01-01").cast("timestamp")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), (start + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 500).cast("int"))).alias("ts"), F.col("source").alias("outlet"), (F.col("doc_id") % 5).cast("int").alias("authority"))


@query()
def story_clusters(spark, d):
    """Every article's story, then a row per story; a sequential version is in the tests."""
    a = _articles(spark, d)
    return stories.summaries(a, stories.told(a))


@query()
def incremental_stories(spark, d):
    """Two loads, one after the other: the second one's articles with their stories and why these are analysed again; a sequential version is in the tests."""
    a = _articles(spark, d).withColumn("arrived", F.col("ts"))
    first = incremental.arrive(a.where("ts < timestamp '2024-01-11'"))
    anchors = first.where("id = story").select("story", "authority", F.lit(None).cast("timestamp").alias("dormant_since"))
    return incremental.attached(incremental.arrive(a.where("ts >= timestamp '2024-01-11'"), first), anchors)


@query()
def fragment_merges(spark, d):
    return stories.followed(stories.merges(_articles(spark, d)))


@query("""
with m as (select event_type as frame, case when user_id % 3 = 2 then user_id - 1 else user_id end as story, value, ts from events) select frame, story, max(value) as confidence, strftime(min(ts), '%Y-%m-%d') as first_seen, strftime(max(ts), '%Y-%m-%d') as last_seen from m group by 1, 2""")
def merged_matches(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("frame"), F.col("user_id").alias("story"), F.col("value").alias("confidence"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    m = e.select(F.col("story").alias("old")).distinct().where("old % 3 = 2").select("old", (F.col("old") - 1).alias("new"))
    return stories.merged_matches(e, m).select("frame", "story", "confidence", _day("first_seen").alias("first_seen"), _day("last_seen").alias("last_seen"))


@query()
def absorbed_noise(spark, d):
    """Topics of the landscape: density clusters of two rows and more on the laid-out plane, then noise near one joins it."""
    p = layout.plane(table(spark, d, "embeddings"), "vec_id", "embedding")
    return density.absorbed(p.join(density.leaves(p, "vec_id", min_size=2), "vec_id"), "vec_id", "cluster")


@query("""
with q as (select event_id, user_id, value, row_number() over (partition by user_id order by value desc nulls last, event_id) as r from events where value >= 60 and event_type in ('click', 'error')) select event_id, user_id from q where r = 1""")
def review_queue(spark, d):
    """What is to be reviewed, one item a story: filtered first, then the best of each."""
    good, _ = review.partition(table(spark, d, "events"), (F.col("value") >= 60) & F.col("event_type").isin("click", "error"))
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id")
    return good.withColumn("r", F.row_number().over(w)).where("r = 1").select("event_id", "user_id")


@query("""
select s, o, count(*) as n from (select o_custkey % 40 as s, o_orderkey % 30 + 10 as o, lower(o_orderpriority || o_orderstatus) as span, min(o_orderkey) as id from orders group by 1, 2, 3) group by 1, 2""")
def claim_records(spark, d):
    """Claims kept once for each normalised span of an article's pair: the first one."""
    r = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("s"), (F.col("o_orderkey") % 30 + 10).alias("o"), F.concat("o_orderpriority", "o_orderstatus").alias("span"), F.col("o_orderkey").alias("id"))
    return claims.first_spans(r, ["s", "o"], "span", "id").groupBy("s", "o").agg(F.count("*").alias("n"))


@query(r"select page_id, case when page_id % 3 = 0 then regexp_extract(url, '/([a-z]{2})/', 1) else '-' end as label from pages")
def rating_labels(spark, d):
    """Ratings scraped from a table's cells, mapped to labels; what is not a known rating is none."""
    html = F.concat(F.lit("<td class='rating'>"), F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "/([a-z]{2})/", 1)).otherwise("Solid"), F.lit("</td>"))
    known = {x: x for x in ("en", "de", "fr", "es")}
    from tessera.sources import feeds

    return table(spark, d, "pages").select("page_id", F.coalesce(feeds.rating(html, r"(?is)<td[^>]*rating[^>]*>(.*?)</td>", known), F.lit("-")).alias("label"))
