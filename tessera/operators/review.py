"""Search boxes, suggestions, briefings and audits over the media tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(rows: DataFrame, filters: dict[str, object], limit: int | None = None) -> DataFrame:
    """Rows that match every filter that is set; "none" means null; the limit is at most 200."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column).isNull() if value == "none" else F.col(column) == value)
    return rows if limit is None else rows.limit(min(limit, 200))


def briefing_score(label_rank: Column, reliability: Column, age_days: Column, horizon: int) -> Column:
    """Label priority times log reliability times linear recency (0.1 at least)."""
    return label_rank * F.log(reliability + 1) / F.log(F.lit(101.0)) * F.greatest(F.lit(0.1), 1 - age_days / horizon)


def best_matches(matches: DataFrame, article: str, confidence: str) -> DataFrame:
    """All matches tied at an article's highest confidence."""
    rank = F.rank().over(Window.partitionBy(article).orderBy(F.desc(confidence)))
    return matches.withColumn("_r", rank).where("_r = 1").drop("_r")


def quadrant(owner: Column, own_hits: Column, other_hits: Column) -> Column:
    """owner and subject: more name hits win, a tie goes to the candidate, none is media."""
    subject = F.when((own_hits == 0) & (other_hits == 0), "media").when(own_hits >= other_hits, "candidate").otherwise("opponent")
    return F.concat_ws("_", owner, subject)


def partition(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    keep = F.coalesce(keep, F.lit(False))
    return rows.where(keep), rows.where(~keep)


def evidence_rollup(relations: DataFrame, key: str, evidence: str) -> DataFrame:
    """(version, relations, entries): over a JSON array of {article_id, extractor_version} per relation; bad JSON counts as none."""
    items = F.from_json(evidence, "array<struct<article_id: bigint, extractor_version: string>>")
    rows = relations.select(key, F.explode_outer(items).alias("e"))
    version = F.coalesce(F.col("e.extractor_version"), F.lit("none"))
    return rows.groupBy(version.alias("version")).agg(F.countDistinct(key).alias("relations"), F.count("e").alias("entries"))


def column_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, blanks and values that hold a NUL; one pass."""
    aggs = [a for c in columns for a in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"b_{c}"), F.count_if(F.col(c).cast("string").contains("\0")).alias(f"z_{c}"))]
    one = rows.agg(F.count("*").alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"b_{c}").alias("blanks"), F.col(f"z_{c}").alias("nuls")) for c in columns])
    return one.select("rows", F.explode(each).alias("c")).select("c.column", "rows", "c.nulls", "c.blanks", "c.nuls")


def threshold_sweep(pairs: DataFrame, score: str, positive: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, recall) for each threshold, in one pass over the pairs."""
    s, p = F.col(score), F.col(positive)
    aggs = [a for i, t in enumerate(thresholds) for a in (F.count_if(p & (s >= t)).alias(f"tp{i}"), F.count_if(~p & (s >= t)).alias(f"fp{i}"), F.count_if(p & (s < t)).alias(f"fn{i}"))]
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)])
    return pairs.agg(*aggs).select(F.explode(each).alias("r")).select("r.*", F.round(F.col("r.tp") / F.greatest(F.col("r.tp") + F.col("r.fn"), F.lit(1)), 4).alias("recall"))
