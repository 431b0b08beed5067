"""Diversity-capped selection, composite scores, alerts and state merges."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def featured(rows: list, most: int = 8, owner: str = "owner", owner_cap: int = 4, stage: str = "stage", stage_cap: int = 3, pinned: str = "pinned", live: str = "live") -> list:
    """Greedy choice from ranked rows (a bounded list): pinned first, caps per owner and stage, then back-fill in rank order.

    Rows that are not live are left out unless pinned; pinned rows count towards the caps.
    """
    rows = [r for r in rows if r[pinned] or r.get(live, True)]
    order = sorted(range(len(rows)), key=lambda i: (not rows[i][pinned], i))
    owners, stages, chosen = Counter(), Counter(), []
    for i in order:
        if len(chosen) == most:
            break
        r = rows[i]
        if r[pinned] or (owners[r[owner]] < owner_cap and stages[r[stage]] < stage_cap):
            chosen.append(i)
            owners[r[owner]] += 1
            stages[r[stage]] += 1
    chosen += [i for i in order if i not in chosen][: most - len(chosen)]
    return [rows[i] for i in chosen]


def reachable(rows: DataFrame, order: list[Column], most: int = 8, owner: str = "owner", stage: str = "stage", pinned: str = "pinned", live: str = "live") -> DataFrame:
    """The rows, in order, that featured() can choose from all of rows: the first `most` of each (pinned, owner, stage) and of all others."""
    some = rows.where(F.col(pinned) | F.col(live))
    by = Window.partitionBy(pinned, owner, stage).orderBy(*order)
    return some.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).drop("_r").orderBy(*order)


def capped_sum(terms: dict[str, tuple[Column, float, float]], penalty: Column) -> Column:
    """Sum over terms of min(value * weight, cap), less the penalty; nulls count as 0."""
    total = F.lit(0.0)
    for value, weight, cap in terms.values():
        total = total + F.least(F.coalesce(value, F.lit(0)) * F.lit(weight), F.lit(cap))
    return total - penalty


def episodes(state: DataFrame, signal: DataFrame, key: str, now: Column) -> DataFrame:
    """Alert state after one round: firing opens or renews (detected_at = now), recovery of an open one resolves it.

    state: key, detected_at, resolved_at; signal: key, firing, recovered.
    """
    j = state.join(signal, key, "full")
    firing, recovered = F.coalesce("firing", F.lit(False)), F.coalesce("recovered", F.lit(False))
    is_open = F.col("detected_at").isNotNull() & F.col("resolved_at").isNull()
    detected = F.when(firing, now).otherwise(F.col("detected_at"))
    resolved = F.when(firing, F.lit(None)).when(is_open & recovered, now).otherwise(F.col("resolved_at"))
    return j.select(key, detected.alias("detected_at"), resolved.alias("resolved_at")).where("detected_at is not null")


def keyword_overlap(a: DataFrame, a_key: str, a_words: Column, b: DataFrame, b_key: str, b_words: Column) -> DataFrame:
    """Pairs of rows that share a word, with how many: the theta join as an equi-join on exploded words."""
    x = a.select(F.col(a_key), F.explode(F.array_distinct(a_words)).alias("w"))
    y = b.select(F.col(b_key), F.explode(F.array_distinct(b_words)).alias("w"))
    return x.join(y, "w").groupBy(a_key, b_key).agg(F.count("*").alias("shared"))


def within_ttl(rows: DataFrame, ts: str, now: Column, days: int, keys: list[str]) -> DataFrame:
    """The newest row of each key that is not older than `days`."""
    live = rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))
    cols = [c for c in rows.columns if c not in keys]
    return live.groupBy(*keys).agg(F.max_by(F.struct(*cols), ts).alias("_r")).select(*keys, "_r.*")
