"""Result sets of narratives: the list of frames with all their counts, one frame's detail, variants and momentum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import counts


def with_counts(items: DataFrame, frames: DataFrame, as_of: Column, tiers: list[str], least: dict[str, int], days: int = 14) -> DataFrame:
    """A row per frame with its pulse, reach, outlets, tiers, sparkline, key stories, stage and trend; zeros where nothing is known.

    items: frame, story, outlet, tier, weight, ts; frames: frame.  Every metric is one aggregate over items, and they meet on the frame.
    sparkline: items of each of the last `days` days, oldest first.  key stories: the first, that of most items, and the latest (ties: the least story).
    """
    seen = items.where("ts is not null")
    c7, c14, c28 = (counts.days_before(as_of, n) for n in (7, 14, 28))
    t = F.col("ts")
    week, last = t >= c7, (t >= c14) & (t < c7)
    ago = F.datediff(as_of.cast("date"), t.cast("date"))
    one = seen.groupBy("frame").agg(
        F.count("*").alias("articles"),
        F.countDistinct("story").alias("total"),
        F.countDistinct(F.when(week, F.col("story"))).alias("this_week"),
        F.countDistinct(F.when(last, F.col("story"))).alias("last_week"),
        F.countDistinct(F.when((t >= c28) & (t < c7), F.col("story"))).alias("prior_three_weeks"),
        F.countDistinct(F.when(week, F.col("outlet"))).alias("outlets"),
        F.countDistinct(F.when(last, F.col("outlet"))).alias("outlets_last_week"),
        F.countDistinct(F.when(week, t.cast("date"))).alias("active_days"),
        F.round(F.coalesce(F.sum(F.when(week, F.col("weight").cast("decimal(20,6)"))), F.lit(0)), 1).cast("double").alias("reach"),
        *[F.countDistinct(F.when(F.col("tier") == x, F.col("outlet"))).alias(x) for x in tiers],
        F.array(*[F.count_if(ago == n) for n in range(days, 0, -1)]).alias("sparkline"),
        F.min(ago).alias("days_since"),
    )
    by_story = seen.groupBy("frame", "story").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    keys = by_story.groupBy("frame").agg(
        F.min_by("story", F.struct("a", "story")).alias("first_story"),
        F.min_by("story", F.struct((-F.col("n")).alias("n"), "story")).alias("peak_story"),
        F.max_by("story", F.struct("b", -F.col("story"))).alias("latest_story"),
    )
    out = frames.select("frame").distinct().join(one, "frame", "left").join(keys, "frame", "left")
    out = out.na.fill(0, [c for c, kind in out.dtypes if kind in ("bigint", "double", "int") and c not in ("frame", "first_story", "peak_story", "latest_story", "days_since")])
    out = out.withColumn("sparkline", F.coalesce("sparkline", F.array_repeat(F.lit(0).cast("long"), days))).withColumn("baseline_weekly", F.col("prior_three_weeks") / 3.0)
    staged = counts.staged(out.withColumnRenamed("baseline_weekly", "per_week"), "total", "this_week", "per_week", "days_since", least).withColumnRenamed("per_week", "baseline_weekly")
    return staged.withColumn("trend", F.when(F.col("this_week") > F.col("last_week"), "up").when(F.col("this_week") < F.col("last_week"), "down").otherwise("flat"))


def timeseries(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(frame, day, stories, reach) of each of the last `days` days: stories by the day they were first seen, reach by the day of the item; dense."""
    start = (as_of - F.expr(f"INTERVAL {days} DAYS")).cast("date")
    first = items.groupBy("frame", "story").agg(F.min("ts").cast("date").alias("day")).groupBy("frame", "day").agg(F.count("*").alias("stories"))
    reach = items.groupBy("frame", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("weight").cast("decimal(20,6)")).alias("reach"))
    calendar = items.select("frame").distinct().select("frame", F.explode(F.sequence(start, F.date_sub(as_of.cast("date"), 1))).alias("day"))
    out = calendar.join(first, ["frame", "day"], "left").join(reach, ["frame", "day"], "left")
    return out.select("frame", "day", F.coalesce("stories", F.lit(0)).alias("stories"), F.round(F.coalesce(F.col("reach").cast("double"), F.lit(0.0)), 1).alias("reach"))


def detail(items: DataFrame, frame: Column, quotes: int = 3) -> DataFrame:
    """A frame's stories: articles, outlets, first and last time, and the longest distinct quotes (ties by text)."""
    own = items.where(F.col("frame") == frame)
    g = own.groupBy("story").agg(F.count("*").alias("articles"), F.countDistinct("outlet").alias("outlets"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    said = own.where("quote is not null").select("story", "quote").distinct()
    top = said.withColumn("r", F.row_number().over(Window.partitionBy("story").orderBy(F.desc(F.char_length("quote")), "quote"))).where(F.col("r") <= quotes)
    top = top.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "quote"))), lambda q: q["quote"]).alias("quotes"))
    return g.join(top, "story", "left")


def variant_articles(members: DataFrame, items: DataFrame, day: Column | None = None) -> DataFrame:
    """(variant, frame, articles, first, last): what each variant's members (variant, item) are, on one day or at all."""
    rows = members.join(items, "item")
    rows = rows if day is None else rows.where(F.to_date("ts") == day)
    return rows.groupBy("variant", "frame").agg(F.countDistinct("item").alias("articles"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def momentum(frames: DataFrame, interest: DataFrame, terms: DataFrame, least: int = 5) -> DataFrame:
    """frames with velocities and signal: null below `least` articles this week and the three before, no_trend_signal where no term matches.

    frames: frame, outlets, outlets_prior, stories, stories_prior; interest: term, velocity; terms: frame, term.  Of a frame's terms the mean velocity counts.
    """
    trend = terms.join(interest, "term").groupBy("frame").agg(F.avg("velocity").alias("trend_velocity"))
    v = lambda a, b: scores.velocity(F.col(a), F.col(b))
    out = frames.join(trend, "frame", "left").withColumn("outlet_velocity", v("outlets", "outlets_prior")).withColumn("story_velocity", v("stories", "stories_prior"))
    enough = F.col("stories") + F.col("stories_prior") >= least
    signal = F.when(enough & F.col("trend_velocity").isNull(), "no_trend_signal").when(enough, scores.momentum(F.col("outlet_velocity"), F.col("story_velocity"), F.col("trend_velocity")))
    return out.withColumn("signal", signal)


def bundle(sections: dict[str, DataFrame], key: str, rank: str) -> DataFrame:
    """Several ranked results as one: section, rank and key."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("section"), F.col(rank).alias("rank"), F.col(key).cast("string").alias("key")) for n, d in sections.items()])


def article_detail(article: DataFrame, related: dict[str, tuple[DataFrame, str, Column]], key: str) -> DataFrame:
    """One article's row with, for each related table (rows, their key, what to keep), the sorted array of what belongs to it."""
    out = article
    for name, (rows, theirs, keep) in related.items():
        own = rows.select(F.col(theirs).alias(key), keep.alias("_k")).join(article.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("_k")).alias(name))
        out = out.join(own, key, "left")
    return out


def region_labels(regions: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """(region, label): the label of the known region whose members agree best (Jaccard from `least`; labels that users gave first, then the least label); null without one.

    regions: region, member; known: label, edited, member.  Regions and known ones meet on their members.
    """
    size = lambda d, k: d.groupBy(k).agg(F.countDistinct("member").alias(f"n_{k}"))
    both = regions.select("region", "member").distinct().join(known.select("label", "edited", "member").distinct(), "member").groupBy("region", "label", "edited").agg(F.count("*").alias("both"))
    both = both.join(size(regions, "region"), "region").join(size(known, "label"), "label")
    j = F.col("both") / (F.col("n_region") + F.col("n_label") - F.col("both"))
    best = both.withColumn("j", j).where(F.col("j") >= least).groupBy("region").agg(F.min_by("label", F.struct((~F.col("edited")).alias("e"), (-F.col("j")).alias("j"), "label")).alias("label"))
    return regions.select("region").distinct().join(best, "region", "left")
