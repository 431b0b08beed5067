"""Cosines by blocks against the expression, pair by pair."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import blocks, upkeep


def made(spark):
    """Copies, zero, empty, missing and other vectors, missing groups, repeated keys."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0, rng.random()]) for _ in range(6)]
        rows.append((i if i % 17 else 3, rng.choice([1, 1, 2, None]), rng.choice([v] * 12 + [rows[-1][2] if rows else v] * 4 + [None, [], [0.0] * 6, v[:3], [None, *v[1:]]])))
    return spark.createDataFrame(rows, "k long, g int, v array<float>").repartition(3)


def joined(df, other):
    l, r = df.select("g", F.col("k").alias("a"), F.col("v").alias("va")), other.select(F.col("g").alias("h"), F.col("k").alias("b"), F.col("v").alias("vb"))  # noqa: E741
    return l.join(r, F.col("g") == F.col("h")).withColumn("s", vectors.cosine(F.col("va"), F.col("vb")))


@pytest.mark.parametrize("side", [4, 4096])
def test_pairs_against_a_join(spark, side, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 40)
    df = made(spark)
    every = joined(df, df).where("a < b")
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    want = rows(every.select("a", "b", F.round(1 - F.col("s"), 4)))
    assert rows(blocks.pairs(df, "g", "k", "v", "d", of=lambda s: 1 - s, side=side)) == want and len(want) > 900
    assert rows(blocks.pairs(df, "g", "k", "v", "s", least=0.25, side=side)) == rows(every.where("s >= 0.25").select("a", "b", F.round("s", 4)))
    probes = df.where("k % 5 = 0")
    w = Window.partitionBy("b").orderBy(F.desc("r"), "a")
    best = joined(df, probes).where("a <> b").withColumn("r", F.round("s", 6)).withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    got = blocks.nearest(df, probes.withColumnRenamed("k", "p"), "g", "k", "p", "v", 4, side=side)
    w = Window.partitionBy("probe").orderBy(F.desc("similarity"), "key")
    assert rows(got.withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("probe", "key", "similarity", "rank")) == rows(best.select("b", "a", "r", "rank"))


def test_no_rows(spark):
    none = made(spark).limit(0)
    assert blocks.pairs(none, "g", "k", "v", "d").count() == 0 and blocks.nearest(none, none, "g", "k", "k", "v", 4).count() == 0


@pytest.mark.parametrize("find", ["similar_entities", "pair_dataset", "nearest_past"])
def test_pairs_of_a_group_are_no_join(spark, find):
    """Cosines of a group's pairs are made in blocks, never by a join of its rows."""
    df = made(spark)
    if find == "similar_entities":
        out = upkeep.similar_entities(df, "k", "g", "v", 0.25)
    elif find == "pair_dataset":
        out = upkeep.pair_dataset(df, "g", "k", "v", 10).where("same")
    else:
        out = upkeep.nearest_past(df, df.select(F.col("k").alias("probe"), "g", "v"), "k", "v", "g")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
