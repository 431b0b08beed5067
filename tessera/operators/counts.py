"""Windowed counts, reach, shares and feeds.  as_of is always explicit (a timestamp column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import stage


def days_before(as_of: Column, days: int) -> Column:
    """Midnight, `days` days before as_of's day."""
    return F.date_trunc("day", as_of) - F.expr(f"INTERVAL {days} DAYS")


def pulse(items: DataFrame, keys: DataFrame, key: str, cluster: str, ts: str, as_of: Column) -> DataFrame:
    """this_week, last_week and total distinct clusters per key; zeros for keys without items; this_week has no upper bound."""
    c7, c14 = days_before(as_of, 7), days_before(as_of, 14)
    t = F.col(ts)
    agg = items.where(t.isNotNull()).groupBy(key).agg(
        F.countDistinct(F.when(t >= c7, F.col(cluster))).alias("this_week"),
        F.countDistinct(F.when((t >= c14) & (t < c7), F.col(cluster))).alias("last_week"),
        F.countDistinct(cluster).alias("total"),
    )
    return keys.select(key).distinct().join(agg, key, "left").na.fill(0, ["this_week", "last_week", "total"])


def windowed_sums(items: DataFrame, key: str, ts: str, weight: Column, as_of: Column, windows: dict[str, tuple[int, int]], digits: int = 1) -> DataFrame:
    """Per key and window (name -> days before as_of: from, to) the rounded sum of weight."""
    t = F.col(ts)

    def within(a: int, b: int) -> Column:
        return (t >= days_before(as_of, a)) & (t < days_before(as_of, b))

    return items.groupBy(key).agg(*[F.round(F.coalesce(F.sum(F.when(within(a, b), weight.cast("decimal(20,6)"))), F.lit(0)), digits).cast("double").alias(n) for n, (a, b) in windows.items()])


def capped_contributions(items: DataFrame, key: str, member: str, authority: Column, cap: int = 9) -> DataFrame:
    """Per key: sum over members of min(items, cap) * authority (5 where unknown)."""
    two = items.groupBy(key, member).agg(F.count("*").alias("n"), F.max(authority).alias("a"))
    return two.groupBy(key).agg(F.sum(F.least("n", F.lit(cap)) * F.coalesce("a", F.lit(5))).alias("contribution"))


def tier_days(items: DataFrame, key: str, ts: str, tier: Column, tiers: list[str], item: str) -> DataFrame:
    """Distinct items per key, day and tier (one column each), and their total."""
    rows = items.select(key, F.to_date(ts).alias("day"), tier.alias("_t"), item)
    return rows.groupBy(key, "day").agg(*[F.countDistinct(F.when(F.col("_t") == t, F.col(item))).alias(t) for t in tiers], F.countDistinct(item).alias("total"))


def shares(items: DataFrame, key: Column, buckets: list[str]) -> DataFrame:
    """Counts and half-even percentages of the buckets in all items that fall in one of them."""
    n = items.groupBy(key.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("bucket").isin(buckets))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("bucket", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 0).cast("long").alias("percent"))


def ranked_value(rows: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the value at place int(p * (n - 1)) of the sorted column.  Only distinct values and their counts are sorted."""
    n = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("upto", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return n.where(F.col("upto") > F.floor((F.col("all") - 1) * p)).agg(F.min("v").alias("value"))


def stage_scale(totals: DataFrame, total: str, week: str, least: dict[str, int]) -> DataFrame:
    """One row of thresholds from nearest-rank percentiles of all frames."""
    q1, q2, w2 = (ranked_value(totals, c, p).select(F.col("value").alias(n)) for c, p, n in ((total, 0.25, "_q1"), (total, 0.5, "_q2"), (week, 0.5, "_w2")))
    s = q1.crossJoin(q2).crossJoin(w2)  # one row each
    return s.select(
        F.greatest(F.lit(least["emerging"]), "_q1").alias("emerging"),
        F.greatest(F.lit(least["resurfacing"]), "_q1").alias("resurfacing"),
        F.greatest(F.lit(least["mainstream"]), "_q2").alias("mainstream"),
        F.greatest(F.lit(least["floor"]), F.floor(F.col("_w2") / 2)).alias("floor"),
        F.lit(least["baseline"]).alias("baseline"),
    )


def staged(frames: DataFrame, total: str, week: str, baseline: str, days_since: str, least: dict[str, int]) -> DataFrame:
    """frames with their lifecycle stage; the number of frames is a dimension's, so one row of thresholds is broadcast."""
    scale = stage_scale(frames, total, week, least)
    out = frames.join(F.broadcast(scale))
    names = ("emerging", "resurfacing", "mainstream", "floor", "baseline")
    out = out.withColumn("stage", stage(F.col(total), F.col(week), F.col(baseline) if baseline != "baseline" else frames[baseline], F.col(days_since), {n: scale[n] for n in names}))
    return out.drop(*[scale[n] for n in names])


def spikes(items: DataFrame, key: str, ts: str, weight: Column, as_of: Column, least: float = 1.5, factor: float = 2.0) -> DataFrame:
    """Keys whose last 24 hours reach `least` and `factor` times the daily mean of the last 7 days (which include them)."""
    t, w = F.col(ts), weight.cast("decimal(20,6)")
    day = F.coalesce(F.sum(F.when((t >= as_of - F.expr("INTERVAL 1 DAY")) & (t < as_of), w)), F.lit(0)).cast("double")
    seven = F.coalesce(F.sum(F.when((t >= as_of - F.expr("INTERVAL 7 DAYS")) & (t < as_of), w)), F.lit(0)).cast("double")
    g = items.groupBy(key).agg(day.alias("reach_24h"), (seven / 7).alias("daily_baseline"))
    return g.where((F.col("reach_24h") >= least) & (F.col("reach_24h") >= factor * F.col("daily_baseline")))


def unproductive(items: DataFrame, feed: str, dropped: Column, volume: int = 30) -> DataFrame:
    """Feeds with at least `volume` items, none of which survived."""
    g = items.groupBy(feed).agg(F.count("*").alias("items"), F.count_if(~dropped).alias("survivors"))
    return g.where((F.col("items") >= volume) & (F.col("survivors") == 0))


def short_body(items: DataFrame, source: str, ts: str, length: Column, as_of: Column) -> DataFrame:
    """Per source: 24-hour and baseline (7 days before that) mean lengths, and whether the short-body alert fires or recovers."""
    t = F.col(ts)
    now = (t >= as_of - F.expr("INTERVAL 1 DAY")) & (t < as_of)
    base = (t >= as_of - F.expr("INTERVAL 7 DAYS")) & (t < as_of - F.expr("INTERVAL 1 DAY"))
    g = items.groupBy(source).agg(F.count_if(now).alias("n24"), F.count_if(base).alias("n7"), F.avg(F.when(now, length)).alias("current"), F.avg(F.when(base, length)).alias("base"))
    fires = (F.col("n7") >= 10) & (F.col("base") >= 300) & (F.col("n24") >= 5) & (F.col("current") < 300) & (F.col("current") < 0.5 * F.col("base"))
    recovers = (F.col("n7") >= 10) & (F.col("n24") >= 5) & (F.col("current") >= 0.7 * F.col("base"))
    return g.select(source, "n24", "n7", F.round("current", 4).alias("current"), F.round("base", 4).alias("base"), F.coalesce(fires, F.lit(False)).alias("fires"), F.coalesce(recovers, F.lit(False)).alias("recovers"))


def silent(items: DataFrame, source: str, ts: str, as_of: Column) -> DataFrame:
    """Sources with at least one item a day over 29 days and none in the last 24 hours."""
    t = F.col(ts)
    g = items.groupBy(source).agg(
        F.count_if((t >= as_of - F.expr("INTERVAL 30 DAYS")) & (t < as_of - F.expr("INTERVAL 1 DAY"))).alias("before"),
        F.count_if((t >= as_of - F.expr("INTERVAL 1 DAY")) & (t < as_of)).alias("now"),
    )
    return g.where((F.col("before") >= 29) & (F.col("now") == 0))
