"""The library's operators on the driver tables, each with its SQL.

Rendering: an article is an event (event_id, ts, value, props), a frame an event_type, a story cluster a user_id, an outlet or feed a
document source; as_of is the midnight after the last event, computed from the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores, text, vectors
from tessera.operators import cluster, counts, graph, review, search, series, stories, textindex, writes
from tessera.sources.tables import table
from tessera.storage import shared_dir, stored
from tessera.streaming import keywords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _as_of(spark: SparkSession, d: str) -> Column:
    last = _events(spark, d).agg(F.date_format(F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd").alias("d")).first()[0]
    return F.lit(last).cast("timestamp_ntz")


#: The same moment in SQL.
NOW = "(select date_trunc('day', max(ts)) + interval 1 day from events)"
DAY = "strftime(cast({} as date), '%Y-%m-%d')"


def _day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


@query(f"""
select k.event_type, count(distinct case when ts >= {NOW} - interval 7 day then user_id end) as this_week,
       count(distinct case when ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day then user_id end) as last_week,
       count(distinct user_id) as total
from (select distinct event_type from events) k left join events e using (event_type) group by 1""")
def frame_pulse(spark, d):
    e = _events(spark, d)
    return counts.pulse(e, e, "event_type", "user_id", "ts", _as_of(spark, d))


@query(f"""
select event_type, cast(round(coalesce(sum(case when ts >= {NOW} - interval 7 day and ts < {NOW} then w end), 0), 1) as double) as week,
       cast(round(coalesce(sum(case when ts >= {NOW} - interval 14 day and ts < {NOW} - interval 7 day then w end), 0), 1) as double) as prior_week,
       cast(round(coalesce(sum(case when ts >= {NOW} - interval 30 day and ts < {NOW} then w end), 0), 1) as double) as month
from (select *, cast(case when user_id % 3 = 0 then user_id * 0.003 else coalesce(nullif(user_id % 10, 0), 5) / 10.0 end as decimal(20,6)) as w from events) group by 1""")
def weighted_reach_windows(spark, d):
    u = F.col("user_id")
    w = scores.reach_weight(F.when((u % 3 == 0), u), F.nullif(u % 10, F.lit(0)))
    w = F.when(u % 3 == 0, u * 0.003).otherwise(w)
    return counts.windowed_sums(_events(spark, d), "event_type", "ts", w, _as_of(spark, d), {"week": (7, 0), "prior_week": (14, 7), "month": (30, 0)})


@query("""
select event_type, cast(sum(least(n, 9) * coalesce(a, 5)) as bigint) as contribution
from (select event_type, user_id, count(*) as n, max(nullif(user_id % 10, 0)) as a from events group by 1, 2) group by 1""")
def capped_contribution(spark, d):
    return counts.capped_contributions(_events(spark, d), "event_type", "user_id", F.nullif(F.col("user_id") % 10, F.lit(0)))


_TIERS = ["national", "regional", "local"]


@query(f"""
select event_type, {DAY.format('ts')} as day, count(distinct case when user_id % 3 = 0 then event_id end) as national,
       count(distinct case when user_id % 3 = 1 then event_id end) as regional, count(distinct case when user_id % 3 = 2 then event_id end) as local,
       count(distinct event_id) as total from events group by 1, 2""")
def tier_daily_pivot(spark, d):
    tier = F.element_at(F.array(*[F.lit(t) for t in _TIERS]), (F.col("user_id") % 3 + 1).cast("int"))
    out = counts.tier_days(_events(spark, d), "event_type", "ts", tier, _TIERS, "event_id")
    return out.withColumn("day", _day("day"))


@query(f"""
with n as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2),
span as (select user_id, min(day) as a, max(day) as b from n group by 1),
cal as (select user_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day from span)
select user_id, strftime(day, '%Y-%m-%d') as day, coalesce(n, 0) as n from cal left join n using (user_id, day)""")
def dense_timeseries(spark, d):
    n = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return series.dense_days(n, "user_id", "day", "n").select("user_id", _day("day").alias("day"), "n")


@query("""
with n as (select event_type as bucket, count(*) as n from events where event_type in ('click', 'view', 'purchase') group by 1)
select bucket, n, cast(round_even(n * 100.0 / (select sum(n) from n), 0) as bigint) as percent from n""")
def share_of_voice(spark, d):
    return counts.shares(_events(spark, d), F.col("event_type"), ["click", "view", "purchase"])


@query(f"""
select user_id, round(a, 4) as reach_24h, round(b / 7, 4) as daily_baseline from (
  select user_id, cast(coalesce(sum(case when ts >= {NOW} - interval 1 day and ts < {NOW} then w end), 0) as double) as a,
         cast(coalesce(sum(case when ts >= {NOW} - interval 7 day and ts < {NOW} then w end), 0) as double) as b
  from (select *, cast(0.5 + user_id % 4 as decimal(20,6)) as w from events) group by 1) where a >= 1.5 and a >= 2 * (b / 7)""")
def spike_alerts(spark, d):
    out = counts.spikes(_events(spark, d), "user_id", "ts", F.col("user_id") % 4 + F.lit(0.5), _as_of(spark, d))
    return out.select("user_id", F.round("reach_24h", 4).alias("reach_24h"), F.round("daily_baseline", 4).alias("daily_baseline"))


_VEL = f"""
select user_id, count(distinct case when ts >= {NOW} - interval 7 day then event_type end) as o1,
       count(distinct case when ts < {NOW} - interval 7 day and ts >= {NOW} - interval 28 day then event_type end) as o3,
       count(case when ts >= {NOW} - interval 7 day then 1 end) as c1,
       count(case when ts < {NOW} - interval 7 day and ts >= {NOW} - interval 28 day then 1 end) as c3
from events group by 1"""


@query(f"""
select user_id, round(o1 / greatest(o3 / 3.0, 1.0), 4) as outlet_velocity, round(c1 / greatest(c3 / 3.0, 1.0), 4) as cluster_velocity,
  case when o1 / greatest(o3 / 3.0, 1.0) >= 2 then 'amplified' when c1 / greatest(c3 / 3.0, 1.0) >= 2 then 'elite_only' else 'stable' end as signal
from ({_VEL})""")
def momentum_class(spark, d):
    c7, c28 = (counts.days_before(_as_of(spark, d), n) for n in (7, 28))
    week, prior = F.col("ts") >= c7, (F.col("ts") < c7) & (F.col("ts") >= c28)
    g = _events(spark, d).groupBy("user_id").agg(F.countDistinct(F.when(week, F.col("event_type"))).alias("o1"), F.countDistinct(F.when(prior, F.col("event_type"))).alias("o3"), F.count_if(week).alias("c1"), F.count_if(prior).alias("c3"))
    o, c = scores.velocity(F.col("o1"), F.col("o3")), scores.velocity(F.col("c1"), F.col("c3"))
    return g.select("user_id", F.round(o, 4).alias("outlet_velocity"), F.round(c, 4).alias("cluster_velocity"), scores.momentum(o, c, F.lit(0.0)).alias("signal"))


_LEAST = {"emerging": 5, "resurfacing": 5, "mainstream": 20, "floor": 3, "baseline": 3}


@query(f"""
with f as (select user_id, count(*) as total, count(case when ts >= {NOW} - interval 7 day then 1 end) as week,
  cast(round_even(count(case when ts >= {NOW} - interval 30 day and ts < {NOW} - interval 7 day then 1 end) * 7 / 23.0, 0) as bigint) as usual,
  date_diff('second', max(ts), {NOW}) / 86400.0 as silent from events group by 1),
s as (select list_sort(list(total)) as t, list_sort(list(week)) as w from f),
k as (select greatest(5, t[cast(floor((len(t) - 1) * 0.25) as int) + 1]) as emerging, greatest(20, t[cast(floor((len(t) - 1) * 0.5) as int) + 1]) as mainstream,
  greatest(3, w[cast(floor((len(w) - 1) * 0.5) as int) + 1] // 2) as flr from s)
select user_id, total, week, usual, case when silent > 14 then 'dormant' when total <= emerging then 'emerging'
  when total >= emerging and week >= greatest(2, flr // 2) and usual = 0 then 'resurfacing'
  when week >= flr and usual >= 3 and week >= usual * 2 then 'spreading' when usual >= 6 and week < usual * 0.5 then 'fading'
  when total >= mainstream then 'mainstream' else 'active' end as stage from f, k""")
def stage_class(spark, d):
    now = _as_of(spark, d)
    c7, c30 = counts.days_before(now, 7), counts.days_before(now, 30)
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    f = _events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") >= c7).alias("week"),
        F.bround(F.count_if((F.col("ts") >= c30) & (F.col("ts") < c7)) * 7 / F.lit(23.0), 0).cast("long").alias("usual"),
        ((seconds(now) - seconds(F.max("ts"))) / 86400.0).alias("silent"),
    )
    return counts.staged(f, "total", "week", "usual", "silent", _LEAST).select("user_id", "total", "week", "usual", "stage")


@query(f"""
select event_type, n24, n7, round(c, 4) as current, round(b, 4) as base, coalesce(n7 >= 10 and b >= 300 and n24 >= 5 and c < 300 and c < 0.5 * b, false) as fires,
  coalesce(n7 >= 10 and n24 >= 5 and c >= 0.7 * b, false) as recovers
from (select event_type, count(case when x then 1 end) as n24, count(case when y then 1 end) as n7, avg(case when x then l end) as c, avg(case when y then l end) as b
  from (select event_type, length(props) * 40 as l, ts >= {NOW} - interval 1 day and ts < {NOW} as x, ts >= {NOW} - interval 7 day and ts < {NOW} - interval 1 day as y from events) group by 1)""")
def source_health(spark, d):
    return counts.short_body(_events(spark, d), "event_type", "ts", F.length("props") * 40, _as_of(spark, d))


@query(f"""
select user_id, count(case when ts >= {NOW} - interval 30 day and ts < {NOW} - interval 1 day then 1 end) as before, cast(0 as bigint) as now
from events group by 1 having count(case when ts >= {NOW} - interval 1 day and ts < {NOW} then 1 end) = 0
and count(case when ts >= {NOW} - interval 30 day and ts < {NOW} - interval 1 day then 1 end) >= 29""")
def silent_sources(spark, d):
    return counts.silent(_events(spark, d), "user_id", "ts", _as_of(spark, d))


@query("select user_id, count(*) as items, cast(0 as bigint) as survivors from events group by 1 having count(*) >= 30 and count(case when not (user_id % 5 = 0 or event_type = 'error') then 1 end) = 0")
def feed_pruning(spark, d):
    dropped = (F.col("user_id") % 5 == 0) | (F.col("event_type") == "error")
    return counts.unproductive(_events(spark, d), "user_id", dropped)


@query(f"select {DAY.format('ts')} as day, event_id, value from events qualify row_number() over (partition by cast(ts as date) order by value desc nulls last, event_id) = 1")
def top1_per_day(spark, d):
    e = _events(spark, d).withColumn("day", _day("ts"))
    return series.first_of(e, ["day"], [F.desc_nulls_last("value"), F.col("event_id")]).select("day", "event_id", "value")


@query("""select cast(isoyear(ts) as int) as iso_year, cast(week(ts) as int) as iso_week, event_id, cast(row_number() over w as int) as rank from events
window w as (partition by isoyear(ts), week(ts) order by value desc nulls last, event_id) qualify row_number() over w <= 2""")
def top2_per_iso_week(spark, d):
    e = _events(spark, d).withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("int"), "iso_week": F.weekofyear("ts").cast("int")})
    return series.first_of(e, ["iso_year", "iso_week"], [F.desc_nulls_last("value"), F.col("event_id")], 2).select("iso_year", "iso_week", "event_id", "rank")


@query(f"""
with n as (select user_id, cast(ts as date) as day, count(*) as n, min(ts) as a, max(ts) as b from events group by 1, 2)
select user_id, strftime(min(a), '%Y-%m-%d %H:%M:%S') as emerged, strftime(arg_max(day, (n, day)), '%Y-%m-%d') as peak_day, max(n) as peak_count,
  case when max(b) < {NOW} - interval 3 day then strftime(max(b), '%Y-%m-%d %H:%M:%S') end as faded from n group by 1""")
def lifecycle_events(spark, d):
    out = series.lifecycle(_events(spark, d), "user_id", "ts", _as_of(spark, d), 3)
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", clock("emerged").alias("emerged"), _day("peak_day").alias("peak_day"), "peak_count", clock("faded").alias("faded"))


@query("""
select event_id, user_id from (select *, lag(value) over w as pv, lead(value) over w as nv, lag(ts) over w as pt, lead(ts) over w as nt from events window w as (partition by user_id order by ts, event_id))
where abs(value - pv) > 15 and abs(nv - value) > 15 and sign(value - pv) <> sign(nv - value)
  and floor((epoch_us(ts) // 1000000 - epoch_us(pt) // 1000000) / 86400) <= 7 and floor((epoch_us(nt) // 1000000 - epoch_us(ts) // 1000000) / 86400) <= 7""")
def isolated_outliers(spark, d):
    e = _events(spark, d)
    return series.isolated_outliers(e, "user_id", "ts", "value").select("event_id", "user_id")


@query("""
select p.event_id, round(arg_min(q.value, (abs(epoch_us(q.ts) - epoch_us(p.ts)), epoch_us(q.ts), q.event_id)), 4) as nearest_value
from (select * from events where event_type = 'purchase') p left join (select * from events where event_type = 'view' and value is not null) q
on p.user_id = q.user_id and abs(epoch_us(q.ts) - epoch_us(p.ts)) <= 64800000000 group by 1""")
def nearest_as_of(spark, d):
    e = _events(spark, d)
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return series.nearest_as_of(left, right, "user_id", "ts", "ts", "value", "18 HOURS", 18 * 3600).select("event_id", F.round("nearest_value", 4).alias("nearest_value"))


@query("""
with v as (select user_id, epoch_us(ts) as t, value as v from events where event_type = 'view' and value is not null),
p as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'purchase'),
b as (select p.event_id, max(v.t) as t0, arg_max(v.v, v.t) as v0 from p join v on p.user_id = v.user_id and v.t <= p.t group by 1),
a as (select p.event_id, min(v.t) as t1, arg_min(v.v, v.t) as v1 from p join v on p.user_id = v.user_id and v.t >= p.t group by 1)
select p.event_id, round(case when v0 is null then v1 when v1 is null or t0 = t1 then v0 else v0 + (v1 - v0) * (p.t - t0) / cast(t1 - t0 as double) end, 3) as value
from p left join b using (event_id) left join a using (event_id)""")
def interpolated_as_of(spark, d):
    e = _events(spark, d)
    p = e.where("event_type = 'purchase'")
    out = series.interpolated(e.where("event_type = 'view'"), p, "user_id", "ts", "value")
    return out.join(p.select("event_id", "user_id", "ts"), ["user_id", "ts"]).select("event_id", F.round("value", 3).alias("value"))


@query("""
with recursive e as (select event_type || '-' || (user_id % 40) as title, epoch_us(ts) as t from events),
g(title, s) as (select title, min(t) from e group by 1 union all
  select g.title, (select min(t) from e where e.title = g.title and e.t > g.s + 86400000000) from g where g.s is not null)
select e.title, strftime(make_timestamp(max(g.s)), '%Y-%m-%d %H:%M:%S') as group_start, e.t as at from e join g on e.title = g.title and g.s <= e.t group by e.title, e.t""")
def anchored_title_groups(spark, d):
    e = _events(spark, d).select(F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string")).alias("title"), F.col("ts").cast("timestamp").alias("ts")).distinct()
    out = series.anchored_groups(e, "title", "ts", 24)
    return out.select("title", F.date_format("group_start", "yyyy-MM-dd HH:mm:ss").alias("group_start"), F.unix_micros("ts").alias("at"))


@query(f"""
with s as (select user_id, cast(ts as date) as day, case when count(*) >= 4 then 'high' when count(*) >= 2 then 'medium' else 'low' end as level from events group by 1, 2)
select user_id, strftime(day, '%Y-%m-%d') as day, level, previous from (select *, lag(level) over (partition by user_id order by day) as previous from s) where level is distinct from previous""")
def stage_transitions(spark, d):
    n = F.count("*")
    s = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.when(n >= 4, "high").when(n >= 2, "medium").otherwise("low").alias("level"))
    return series.changes(s, ["user_id"], ["day"], "level").select("user_id", _day("day").alias("day"), "level", "previous")


@query("""
with d as (select cast(ts as date) as day, avg(case when event_type = 'view' then value end) as x, avg(case when event_type = 'click' then value end) as y,
  avg(case when event_type = 'view' then user_id % 25 end) as sx, avg(case when event_type = 'click' then user_id % 25 end) as sy from events group by 1),
c as (select *, case when x is null then 0 else greatest(0, 1 - sx / 20) end as a, case when y is null then 0 else greatest(0, 1 - sy / 20) end as b from d)
select strftime(day, '%Y-%m-%d') as day, round(case when a + b > 0 then (coalesce(x * a, 0) + coalesce((100 - y) * b, 0)) / (a + b) else coalesce(x, 100 - y) end, 2) as blend from c""")
def market_blend(spark, d):
    pick = lambda kind, c: F.avg(F.when(F.col("event_type") == kind, c))
    spread = F.col("user_id") % 25
    g = _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(pick("view", F.col("value")).alias("x"), pick("click", F.col("value")).alias("y"), pick("view", spread).alias("sx"), pick("click", spread).alias("sy"))
    return g.select(_day("day").alias("day"), scores.blend(F.col("x"), F.col("sx"), F.col("y"), F.col("sy")).alias("blend"))


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def unmatched_items(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return writes.orphans(table(spark, d, "orders"), c, "o_custkey", "c_custkey").select("o_orderkey")


@query("""select n_name, count(*) as orders, count(distinct c_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by 1 order by orders desc, n_name limit 10""")
def suggestions_topn(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"))
    out = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    return out.agg(F.sum("n").alias("orders"), F.count("*").alias("customers")).orderBy(F.desc("orders"), "n_name").limit(10)


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, count(distinct user_id) as users from events group by 1, 2")
def props_rollup(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return _events(spark, d).groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_TITLE = "split_part(text, chr(10), 1)"


def _titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source")


_STOP = "[" + ",".join(f"'{w}'" for w in text.TITLE_STOPWORDS) + "]"


@query(rf"""
with t as (select doc_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace({_TITLE}, '\s+[-|:]\s+[^-|:]{{2,60}}$', '')), '[^a-z0-9]+'),
  lambda w: regexp_matches(w, '^[0-9]+$') or (length(w) > 2 and not list_contains({_STOP}, w)))) as w from documents),
x as (select doc_id, unnest(w) as w from t), p as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2)
select a, b, round(n / cast(len(s.w) + len(u.w) - n as double), 4) as similarity from p join t s on s.doc_id = a join t u on u.doc_id = b where n / cast(len(s.w) + len(u.w) - n as double) >= 0.65""")
def title_jaccard_pairs(spark, d):
    """Prefix filter: pairs of similarity >= 0.65 share one of the rarest 35 % (and one) of the words of either title."""
    return cluster.token_pairs(_titles(spark, d).select("doc_id", text.title_tokens(F.col("title")).alias("w")), "doc_id", "w", 0.65)


@query(r"""
with q as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as s, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') as h,
  regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') as p,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.') and not regexp_matches(x, '(?i)^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|ref_url|share|sharedfrom|amp)='))) as k from pages)
select page_id, s || '://' || h || p || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end as canonical from q""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(r"""
with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') as t from pages),
b as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) as t from a)
select page_id, md5(t) as digest, cast(length(t) as int) as chars from b""")
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("chars"))


@query("select doc_id, label, round(score, 4) as score from (select vec_id as doc_id, label, list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)) as score from embeddings) where score >= 0.3")
def shortlist_threshold(spark, d):
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    out = e.join(F.broadcast(probe)).select(F.col("vec_id").alias("doc_id"), "label", vectors.cosine(F.col("embedding"), F.col("probe")).alias("score"))
    return out.where("score >= 0.3").withColumn("score", F.round("score", 4))


def _centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label")
    return c.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


@query("select label, cast(i - 1 as int) as i, floor(cast(sum(cast(x as decimal(24,12))) as double) / count(*) * 10000 + 0.5) / 10000 as x from (select label, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2")
def centroid_by_label(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    exact = F.sum(F.col("x").cast("double").cast("decimal(24,12)")).cast("double")  # no order of summation shows in the last digit
    return e.groupBy("label", "i").agg((F.floor(exact / F.count("*") * 10000 + 0.5) / 10000).alias("x"))


@query("""
with c as (select label, i, avg(x) as x from (select label, unnest(range(1, 65)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2),
k as (select label, list(x order by i) as v from c group by 1),
s as (select vec_id, k.label as frame, list_cosine_similarity(cast(embedding as double[]), v) as s from embeddings, k)
select vec_id, frame, cast(row_number() over (partition by vec_id order by round(s, 6) desc, frame) as int) as rank from s where s >= 0.1 qualify row_number() over (partition by vec_id order by round(s, 6) desc, frame) <= 3""")
def cosine_topk(spark, d):
    k = _centroids(spark, d).withColumnRenamed("label", "frame")  # a row per frame
    s = table(spark, d, "embeddings").join(k).withColumn("s", vectors.cosine(F.col("embedding"), F.col("centroid"))).where("s >= 0.1")
    return series.first_of(s.withColumn("r", F.round("s", 6)), ["vec_id"], [F.desc("r"), F.col("frame")], 3).select("vec_id", "frame", "rank")


def _edges(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = o.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    e = e.unionByName(c.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")))
    return e.unionByName(n.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")))


_EDGES = """e as (select 'o' || o_orderkey as src, 'c' || o_custkey as dst from orders union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation)"""


@query(f"""
with recursive {_EDGES}, b as (select src, dst from e union select dst, src from e),
w(node, hop) as (select 'r0', 0 union select dst, hop + 1 from w join b on node = src where hop < 3)
select node, cast(min(hop) as int) as hop from w group by 1""")
def n_hop(spark, d):
    return graph.neighbourhood(_edges(spark, d), spark.createDataFrame([("r0",)], "node string"), 3)


@query(f"""
with recursive {_EDGES}, p(path, last, hops) as (select src || '>' || dst, dst, 1 from e where src in ('o0', 'o1', 'o32', 'o33') union all select path || '>' || dst, dst, hops + 1 from p join e on last = src where hops < 4)
select path, cast(hops as int) as hops from p where last like 'r%'""")
def simple_paths(spark, d):
    start = spark.createDataFrame([("o0",), ("o1",), ("o32",), ("o33",)], "node string")
    goal = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    out = graph.simple_paths(_edges(spark, d), start, goal, 4)
    return out.select(F.array_join("path", ">").alias("path"), "hops")


@query("""
with m as (select distinct event_type as g, user_id as m from events where ts >= (select max(ts) from events) - interval 2 day), n as (select g, count(*) as n from m group by 1)
select a.g as a, b.g as b, count(*) as weight, round(count(*) / cast(least(max(x.n), max(y.n)) as double), 4) as share
from m a join m b on a.m = b.m and a.g < b.g join n x on x.g = a.g join n y on y.g = b.g group by 1, 2""")
def frame_overlap(spark, d):
    e = _events(spark, d)
    last = e.agg(F.max("ts").alias("_last"))
    recent = e.join(F.broadcast(last)).where(F.col("ts") >= F.col("_last") - F.expr("INTERVAL 2 DAYS"))
    return graph.overlaps(recent, "event_type", "user_id")


@query("""
select o_custkey, s as support, o as oppose, s + o as total, least(s, o) as balance from (select o_custkey, count(case when o_orderstatus = 'F' then 1 end) as s, count(case when o_orderstatus = 'O' then 1 end) as o from orders group by 1)
where s + o > 0 and s >= 0.25 * (s + o) and o >= 0.25 * (s + o)""")
def contradictions(spark, d):
    r = table(spark, d, "orders").select("o_custkey", F.lit(1).alias("x"), (F.col("o_orderstatus") == "F").cast("long").alias("s"), (F.col("o_orderstatus") == "O").cast("long").alias("o"))
    return graph.contradictions(r, "o_custkey", "x", "s", "o").drop("x")


_WORDS = ["the", "and", "der", "les", "license"]


@query(r"select doc_id, source from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(license|the end|der|les)($|[^A-Za-z0-9])') or source = 'src1'")
def keyword_gate(spark, d):
    pattern = text.keyword_pattern(["license", "the end", "der", "les"])
    return table(spark, d, "documents").where(F.col("text").rlike(pattern) | (F.col("source") == "src1")).select("doc_id", "source")


@query(r"""
select doc_id, cast(greatest(0, least(100, 30 + case when source is not null then 10 else 0 end + case when length(text) > 500 then 10 else 0 end + case when length(text) > 1500 then 5 else 0 end
  + case when regexp_matches(text, '\d') then 15 else 0 end - case when lang = 'es' then 15 else 0 end)) as int) as score from documents""")
def evidence_score(spark, d):
    t = F.col("text")
    s = F.lit(30) + F.when(F.col("source").isNotNull(), 10).otherwise(0) + F.when(F.length(t) > 500, 10).otherwise(0) + F.when(F.length(t) > 1500, 5).otherwise(0) + F.when(t.rlike(r"[0-9]"), 15).otherwise(0) - F.when(F.col("lang") == "es", 15).otherwise(0)
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("int").alias("score"))


@query(r"""
with r as (select doc_id, (length(lower(text)) - length(replace(lower(text), 'version', ''))) // 7 as n, contains(lower(text), 'version 2.0') as p from documents)
select doc_id, cast(n as bigint) as hits, p as phrase from r where p order by n desc, doc_id limit 10""")
def fts_phrase(spark, d):
    docs = table(spark, d, "documents")
    found = search.phrase_or_any(docs, "doc_id", "text", "version 2.0", 1 << 30).select("doc_id", "phrase")
    low = F.lower("text")
    n = F.floor((F.length(low) - F.length(F.replace(low, F.lit("version"), F.lit("")))) / 7)
    return docs.join(found, "doc_id").select("doc_id", n.alias("hits"), "phrase").orderBy(F.desc("hits"), "doc_id").limit(10)


def _ranked_sql(first, second):
    """BM25 of two words, the phrase first, over whole texts."""
    return rf"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from documents), c as (
select doc_id, len(w) as n, len(list_filter(w, lambda x: x = '{first}')) as a, len(list_filter(w, lambda x: x = '{second}')) as b, len(list_filter(range(1, len(w)), lambda i: w[i] = '{first}' and w[i + 1] = '{second}')) as p from w where len(w) > 0), t as (
select count(*) as docs, sum(n) as words, count_if(a > 0) as na, count_if(b > 0) as nb, max(p) as most from c), s as (
select doc_id, p, most, a, b, ln(1 + (docs - na + 0.5) / (na + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n * docs / words)) + ln(1 + (docs - nb + 0.5) / (nb + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n * docs / words)) as score from c, t)
select doc_id, round(score, 5) as score, cast(p as bigint) as phrase_hits from s where p > 0 or (most = 0 and a + b > 0)"""


def _ranked(spark, d, words):
    at = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    textindex.build(table(spark, d, "documents"), "doc_id", "text", at)
    return textindex.search(spark, at, words).select(F.col("doc").alias("doc_id"), F.round("score", 5).alias("score"), "phrase_hits")


@query(_ranked_sql("of", "the"))
def fts_ranked(spark, d):
    """Documents with the phrase, ranked: the index is written, then read by its terms."""
    return _ranked(spark, d, ["of", "the"])


@query(_ranked_sql("que", "und"))
def fts_any_ranked(spark, d):
    """No document has the phrase: those with either word, ranked."""
    return _ranked(spark, d, ["que", "und"])


@query(f"""
select o_custkey, o_orderpriority, max(o_totalprice) as confidence, strftime(min(o_orderdate), '%Y-%m-%d') as first_seen, strftime(max(o_orderdate), '%Y-%m-%d') as last_seen from orders group by 1, 2""")
def upsert_match(spark, d):
    o = table(spark, d, "orders").withColumns({"confidence": F.col("o_totalprice"), "first_seen": _day("o_orderdate"), "last_seen": _day("o_orderdate")})
    return writes.merge(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], most=["confidence", "last_seen"], least=["first_seen"])


@query(f"""
with k as (select event_type, {DAY.format('ts')} as day, min(case when user_id % 2 = 0 then event_id end) as a, min(event_id) as b from events group by 1, 2)
select event_type, day, coalesce(a, b) as event_id from k""")
def insert_ignore(spark, d):
    e = _events(spark, d).select("event_type", _day("ts").alias("day"), "event_id", "user_id")
    old = series.first_of(e.where("user_id % 2 = 0"), ["event_type", "day"], [F.col("event_id")]).select("event_type", "day", "event_id")
    return writes.insert_ignore(old, e.where("user_id % 2 = 1").select("event_type", "day", "event_id"), ["event_type", "day"], ["event_id"])


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def unique_audit(spark, d):
    return writes.duplicates(_events(spark, d), ["user_id", "event_type"])


@query("""
select l_suppkey, count(distinct l_orderkey) as clusters, round(cast(sum(cast(l_quantity as decimal(20,6))) as double), 1) as mentions from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0 group by 1 order by clusters desc, l_suppkey limit 20""")
def join_aggregated(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    g = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("l_suppkey")
    return g.agg(F.countDistinct("l_orderkey").alias("clusters"), F.round(F.sum(F.col("l_quantity").cast("decimal(20,6)")).cast("double"), 1).alias("mentions")).orderBy(F.desc("clusters"), "l_suppkey").limit(20)


@query("""
select c_custkey, n_name, r_name, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2, 3""")
def three_hop_left(spark, d):
    c, o, n, r = (table(spark, d, t) for t in ("customer", "orders", "nation", "region"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left").join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return j.groupBy("c_custkey", "n_name", "r_name").agg(F.count("o_orderkey").alias("n"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_orderpriority = '1-URGENT'")
def semi_or(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_in")).distinct()
    return o.join(c, "o_custkey", "left").where("_in or o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("""
select a.day, coalesce(v, 0) as views, coalesce(c, 0) as clicks from (select coalesce(x.day, y.day) as day, v, c from
 (select strftime(cast(ts as date), '%Y-%m-%d') as day, count(*) as v from events where event_type = 'view' group by 1) x full join
 (select strftime(cast(ts as date), '%Y-%m-%d') as day, count(*) as c from events where event_type = 'click' group by 1) y on x.day = y.day) a""")
def full_outer_days(spark, d):
    e = _events(spark, d).withColumn("day", _day("ts"))
    v = e.where("event_type = 'view'").groupBy("day").agg(F.count("*").alias("views"))
    c = e.where("event_type = 'click'").groupBy("day").agg(F.count("*").alias("clicks"))
    return v.join(c, "day", "full").na.fill(0)


@query("""select event_id, keyword from (select event_id, case when contains(t, 'click') then 'click' when contains(t, 'error') then 'error' when contains(t, 'k": 6') then 'k": 6' end as keyword from (select *, lower(event_type || props) as t from events)) where keyword is not null""")
def stream_keyword_match(spark, d):
    """The stream's filter as a batch query; tests run it as a stream with a watermark."""
    e = _events(spark, d).withColumn("text", F.concat("event_type", "props"))
    return keywords.matched(e, "text", ["error", "click", 'k": 6']).select("event_id", "keyword")


@query("""
select role, count(*) as sentences, count(case when q then 1 end) as questions from (select role, ends_with(trim(s), '?') as q from (select role, unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) as s from conversations) where trim(s) <> '') group by 1""")
def sentence_classes(spark, d):
    s = table(spark, d, "conversations").select("role", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]?"), F.lit(0))).alias("s")).where(F.trim("s") != "")
    return s.groupBy("role").agg(F.count("*").alias("sentences"), F.count_if(F.trim("s").endswith("?")).alias("questions"))


@query("""
select priority, cast(count(*) as bigint) as n from (select cast(greatest(0, floor((user_id % 100) * 0.6) + floor((event_id % 100) * 0.35) + case event_type when 'error' then 10 when 'click' then 5 else 0 end + case when value > 50 then 20 else 0 end
 + case when event_id % 30 <= 3 then 10 when event_id % 30 <= 7 then 5 else 0 end - case when event_id % 11 = 0 then 25 when event_id % 7 = 0 then 10 else 0 end) as bigint) as priority from events) group by 1""")
def priority_scores(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    s = scores.priority(u % 100, e % 100, F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "medium"), e % 30, F.when(e % 11 == 0, "poor").when(e % 7 == 0, "mixed"), F.col("value") > 50, F.lit(False))
    return _events(spark, d).select(s.cast("long").alias("priority")).groupBy("priority").agg(F.count("*").alias("n"))


@query("""
select label, cast(sum(quality) as bigint) as good, cast(sum(toxic) as bigint) as toxic, count(*) as n, case when sum(quality) >= 55 then 'approve' when sum(quality) < 30 then 'dismiss' else 'keep' end as decision
from (select coalesce(source, 'unlabeled') as label, quality, toxic from labels join documents using (doc_id)) group by 1""")
def label_histogram(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy(F.coalesce("source", F.lit("unlabeled")).alias("label")).agg(F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"), F.count("*").alias("n"))
    return g.withColumn("decision", scores.review(F.col("good"), F.lit(False)))


@query("""
with n as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, event_type as modal_type, n as modal_count from n qualify row_number() over (partition by user_id order by n desc, length(event_type) desc, event_type) = 1""")
def modal_owner(spark, d):
    n = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return series.first_of(n, ["user_id"], [F.desc("n"), F.desc(F.length("event_type")), F.col("event_type")]).select("user_id", F.col("event_type").alias("modal_type"), F.col("n").alias("modal_count"))


@query(f"""
with w as (select user_id, count(case when ts >= {NOW} - interval 7 day then 1 end) as c, count(case when ts < {NOW} - interval 7 day and ts >= {NOW} - interval 14 day then 1 end) as p from events group by 1)
select user_id, c as current, p as prior, case when p = 0 then case when c > 0 then 'rising' else 'stable' end when c > p * 1.3 then 'rising' when c < p * 0.7 then 'falling' else 'stable' end as trend from w""")
def issue_trend(spark, d):
    now = _as_of(spark, d)
    c7, c14 = counts.days_before(now, 7), counts.days_before(now, 14)
    g = _events(spark, d).groupBy("user_id").agg(F.count_if(F.col("ts") >= c7).alias("current"), F.count_if((F.col("ts") < c7) & (F.col("ts") >= c14)).alias("prior"))
    return g.withColumn("trend", scores.trend(F.col("current"), F.col("prior")))


@query()
def simhash_pairs(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", stories.simhash("text").alias("h"))
    return stories.simhash_pairs(stored(hashed, "simhashes"), "doc_id", "h")


@query(r"""
with t as (select event_id, user_id, event_type, value from events where event_id % 1 = 0),
g as (select user_id, count(*) as rows, count(distinct event_id) as articles, count(distinct event_type) as outlets from t group by 1 having count(*) >= 3 and count(distinct event_id) >= 3 and count(distinct event_type) >= 2),
n as (select user_id, event_type, count(*) as n from t group by 1, 2 qualify row_number() over (partition by user_id order by count(*) desc, length(event_type) desc, event_type desc) = 1)
select user_id, rows, articles, outlets, event_type as modal_name from g join n using (user_id)""")
def promotable_clusters(spark, d):
    return cluster.promotable(_events(spark, d), "user_id", "event_id", "event_type", "event_type")


@query("select user_id, event_id as representative from events qualify row_number() over (partition by user_id order by coalesce(nullif(event_id % 10, 0), 1) desc, length(props) desc, ts, event_id) = 1")
def cluster_representative(spark, d):
    out = cluster.representative(_events(spark, d), "user_id", F.nullif(F.col("event_id") % 10, F.lit(0)), F.length("props"), "ts", "event_id")
    return out.select("user_id", F.col("event_id").alias("representative"))


@query("select user_id, sha256(string_agg(event_id, ',' order by event_id)) as fingerprint from events group by 1")
def cluster_fingerprint(spark, d):
    return _events(spark, d).groupBy("user_id").agg(cluster.fingerprint(F.collect_list("event_id")).alias("fingerprint"))


@query("select event_type, count(*) as n, triage from (select event_type, case when value >= 85 then 'merge' when (user_id % 100) / 100.0 >= 0.5 then 'uncertain' when event_id % 9 = 0 then 'noise' when event_id % 10 = 9 then 'promote' else 'review' end as triage from events) group by 1, 3")
def triage_cascade(spark, d):
    t = cluster.triage(F.col("value") / 100, F.col("user_id") % 100 / 100, F.col("event_id") % 9 == 0, F.col("event_id") % 10 / 10)
    return _events(spark, d).groupBy("event_type", t.alias("triage")).agg(F.count("*").alias("n"))


@query()
def frame_variants(spark, d):
    e = table(spark, d, "embeddings")
    return cluster.variants(e, "label", "vec_id", "embedding")


@query()
def variant_summaries(spark, d):
    """Variants with their size, span and centroid (its first component, rounded)."""
    e = table(spark, d, "embeddings").withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 90).cast("int")))
    out = cluster.variant_summaries(e, cluster.variants(e, "label", "vec_id", "embedding"), "label", "vec_id", "embedding", "ts")
    return out.select("label", "variant", "quotes", "first_seen", "last_seen", F.round(F.get("centroid", F.lit(0)), 6).alias("centroid"))


@query("""select o_custkey, o_orderkey, o_orderpriority from orders qualify rank() over (partition by o_custkey order by o_orderpriority desc) = 1""")
def cited_matches(spark, d):
    return review.best_matches(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


@query("""select quadrant, count(*) as n from (select event_type || '_' || case when a = 0 and b = 0 then 'media' when a >= b then 'candidate' else 'opponent' end as quadrant from (select event_type, user_id % 3 as a, event_id % 4 as b from events)) group by 1""")
def quadrants(spark, d):
    q = review.quadrant(F.col("event_type"), F.col("user_id") % 3, F.col("event_id") % 4)
    return _events(spark, d).groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))


@query("""
select c as "column", (select count(*) from documents) as rows, nulls, blanks, cast(0 as bigint) as nuls from (select 'text' as c, count(*) - count(text) as nulls, count(case when trim(text) = '' then 1 end) as blanks from documents
union all select 'lang', count(*) - count(lang), count(case when trim(lang) = '' then 1 end) from documents union all select 'source', count(*) - count(source), count(case when trim(source) = '' then 1 end) from documents)""")
def column_audit(spark, d):
    return review.column_audit(table(spark, d, "documents"), ["text", "lang", "source"])


@query("""
with t(threshold) as (values (0.0), (25.0), (50.0), (75.0))
select cast(threshold as double) as threshold, tp, fp, fn, round(tp / cast(greatest(tp + fn, 1) as double), 4) as recall from (
select threshold, count(case when event_type = 'view' and value >= threshold then 1 end) as tp, count(case when event_type <> 'view' and value >= threshold then 1 end) as fp, count(case when event_type = 'view' and value < threshold then 1 end) as fn from events, t group by 1)""")
def threshold_sweep(spark, d):
    e = _events(spark, d).withColumn("positive", F.col("event_type") == "view")
    return review.threshold_sweep(e, "value", "positive", [0.0, 25.0, 50.0, 75.0])


@query("""
select event_id, round(r * ln(user_id % 100 + 1) / ln(101) * greatest(0.1, 1 - age / 30.0), 4) as score from (select *, case event_type when 'error' then 3 when 'purchase' then 2 else 1 end as r, event_id % 40 as age from events) order by score desc, event_id limit 25""")
def briefing_topk(spark, d):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    s = review.briefing_score(rank, F.col("user_id") % 100, F.col("event_id") % 40, 30)
    return _events(spark, d).select("event_id", F.round(s, 4).alias("score")).orderBy(F.desc("score"), "event_id").limit(25)


@query("select event_id, event_type, user_id from events where event_type = 'click' and user_id = (select min(user_id) from events) order by event_id limit 200")
def optional_filters(spark, d):
    first = _events(spark, d).agg(F.min("user_id")).first()[0]
    rows = _events(spark, d).select("event_id", "event_type", "user_id").orderBy("event_id")
    return review.optional_filters(rows, {"event_type": "click", "user_id": first}, 500)


@query("select c_mktsegment, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal desc nulls last, c_custkey) <= 3")
def top3_per_entity(spark, d):
    return series.first_of(table(spark, d, "customer"), ["c_mktsegment"], [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("select kind, id, day from (select 'order' as kind, o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders union all select 'event', event_id, strftime(ts, '%Y-%m-%d') from events)")
def timeline_union(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), _day("o_orderdate").alias("day"))
    e = _events(spark, d).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), _day("ts").alias("day"))
    return o.unionByName(e)


@query("select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey where l_discount >= 0.09 and o_orderstatus not in ('P')")
def inner_join_filtered(spark, d):
    l, o = table(spark, d, "lineitem").where("l_discount >= 0.09"), table(spark, d, "orders").where(~F.col("o_orderstatus").isin("P"))  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("select p_partkey, p_name from part where p_name ilike '%an%' and contains(lower(p_type), 'e') order by p_retailprice desc nulls last, p_partkey limit 30")
def ilike_search(spark, d):
    p = table(spark, d, "part")
    return p.where(F.col("p_name").ilike("%an%") & search.contains_escaped(F.col("p_type"), "E")).orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_name")


@query("select node, min(node) over (partition by c_nationkey, c_mktsegment) as component from (select 'c' || c_custkey as node, c_nationkey, c_mktsegment from customer union all select distinct 'g-' || c_nationkey || '-' || c_mktsegment, c_nationkey, c_mktsegment from customer)")
def entity_components(spark, d):
    """Customers linked through shared nations and segments."""
    c = table(spark, d, "customer")
    key = F.concat_ws("-", F.lit("g"), F.col("c_nationkey").cast("string"), "c_mktsegment")
    e = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), key.alias("dst"))
    return graph.components(e)
