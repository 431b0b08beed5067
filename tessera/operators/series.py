"""Time series: calendars, neighbours, as-of joins, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored


def dense_days(counts: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """counts per key and day, with zeros for the missing days between the first and last day of each key."""
    span = counts.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = span.select(key, F.explode(F.sequence("a", "b")).alias(day))
    return calendar.join(counts, [key, day], "left").na.fill(0, [value])


def first_of(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by order, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def lifecycle(items: DataFrame, key: str, ts: str, as_of: Column, stale_days: int) -> DataFrame:
    """emerged, peaked (the day of most items; ties: the latest) and, if stale, faded."""
    days = items.where(F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    g = days.groupBy(key).agg(F.min("first").alias("emerged"), F.max_by("day", F.struct("n", "day")).alias("peak_day"), F.max("n").alias("peak_count"), F.max("last").alias("last"))
    return g.select(key, "emerged", "peak_day", "peak_count", F.when(F.col("last") < as_of - F.expr(f"INTERVAL {stale_days} DAYS"), F.col("last")).alias("faded"))


def isolated_outliers(series: DataFrame, source: str, ts: str, value: str, points: float = 15.0, days: int = 7) -> DataFrame:
    """Rows that jump by more than `points` from both neighbours in opposite directions, both at most `days` whole days away."""
    w = Window.partitionBy(source).orderBy(ts)
    rows = series.withColumns({"_pv": F.lag(value).over(w), "_nv": F.lead(value).over(w), "_pt": F.lag(ts).over(w), "_nt": F.lead(ts).over(w)})
    up, down = F.col(value) - F.col("_pv"), F.col("_nv") - F.col(value)
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    near = (F.floor((second(ts) - second("_pt")) / 86400) <= days) & (F.floor((second("_nt") - second(ts)) / 86400) <= days)
    return rows.where((F.abs(up) > points) & (F.abs(down) > points) & (F.signum(up) != F.signum(down)) & near).drop("_pv", "_nv", "_pt", "_nt")


def nearest_as_of(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, tolerance: str, seconds: int) -> DataFrame:
    """left with the value of right nearest to left.at within `tolerance` (an INTERVAL text of `seconds`), ties to the earlier.

    A range join made an equi-join: both sides are bucketed by `seconds`, and left looks at its own and both neighbour buckets.
    """
    epoch = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    size = seconds * 1_000_000
    # Stored, because the numbers are read twice and another run of the plan may number otherwise.
    l = stored(left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_at", epoch(at)), "numbered")  # noqa: E741
    probe = l.select("_row", key, "_at", F.explode(F.array(*[F.floor(F.col("_at") / size) + d for d in (-1, 0, 1)])).alias("_b"))
    r = right.select(key, F.floor(epoch(ts) / size).alias("_b"), epoch(ts).alias("_t"), F.col(value).alias("_v")).where("_v is not null")
    hit = probe.join(r, [key, "_b"]).where(F.abs(F.col("_t") - F.col("_at")) <= size)
    best = hit.groupBy("_row").agg(F.min_by("_v", F.struct(F.abs(F.col("_t") - F.col("_at")), "_t")).alias(f"nearest_{value}"))
    return l.join(best, "_row", "left").drop("_row", "_at")


def interpolated(points: DataFrame, probes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """probes (key, ts) with value interpolated linearly between the neighbours in points; clamped outside their range."""
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    both = points.select(key, ts, F.col(value).alias("_v"), F.lit(False).alias("_probe")).unionByName(probes.select(key, ts, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_probe")))
    both = both.withColumn("_t", t).withColumn("_k", F.when(F.col("_v").isNotNull(), F.col("_t")))
    w = Window.partitionBy(key).orderBy("_t", "_probe")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("_t", "_probe").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"v0": F.last("_v", True).over(back), "t0": F.last("_k", True).over(back), "v1": F.first("_v", True).over(ahead), "t1": F.first("_k", True).over(ahead)})
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("_t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    out = F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull() | (F.col("t0") == F.col("t1")), F.col("v0")).otherwise(line)
    return both.where("_probe").select(key, ts, out.alias(value))


def anchored_groups(items: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """items of a key in time order; a group starts when an item is more than `hours` after the group's FIRST item (not a gap rule).

    One fold per key over its sorted times, in the JVM; adds group_start.
    """
    limit = hours * 3600 * 1_000_000
    g = items.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list(F.unix_micros(F.col(ts).cast("timestamp"))))).alias("times"))
    empty = F.array().cast("array<bigint>")
    starts = F.aggregate("times", empty, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > limit), F.concat(acc, F.array(t))).otherwise(acc))
    spans = g.select(key, F.explode(starts).alias("_s"), starts.alias("_all"))
    nxt = F.array_min(F.filter("_all", lambda x: x > F.col("_s")))
    spans = spans.select(key, "_s", F.coalesce(nxt, F.lit(2**62)).alias("_e"))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return items.withColumn("_t", t).join(spans, key).where("_t >= _s and _t < _e").withColumn("group_start", F.timestamp_micros("_s")).drop("_t", "_s", "_e")


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it in the group (the first row counts)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("previous", before).where(~F.col(value).eqNullSafe(F.col("previous")))
