"""Pairs of token sets against every pair, with copies."""

import random

from pyspark.sql import functions as F

from tessera.operators import cluster


def found(spark, sets, least):
    df = spark.createDataFrame(list(enumerate(sets)), "k long, w array<string>").repartition(3)
    return sorted((r.a, r.b, r.similarity) for r in cluster.token_pairs(df, "k", "w", least).collect())


def plain(sets, least):
    out = []
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            a, b = set(x or ()), set(sets[j] or ())
            if a and b and len(a & b) / len(a | b) >= least:
                out.append((i, j, int(len(a & b) / len(a | b) * 10000 + 0.5) / 10000))
    return out


def test_pairs_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(cluster, "CHUNK", 3)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    sets = [None, [], ["w1"], ["w1"]]
    for _ in range(150):
        base = list(rng.choice(sets[2:])) if rng.random() < 0.6 else rng.sample(words, rng.randrange(1, 30))
        for _ in range(rng.randrange(4)):
            w = rng.choice(words)
            base = [x for x in base if x != w] if w in base and len(base) > 1 else [*base, *([w] if w not in base else [])]
        sets.append(rng.sample(base, len(base)))
    for least in (0.5, 0.65, 0.9):
        want = plain(sets, least)
        assert found(spark, sets, least) == want and len(want) > 80


def test_a_limit_that_is_just_reached(spark):
    """0.55 * 100 is a little over 55 in floating point: the prefix was cut one token short."""
    large = [f"x{i:03}" for i in range(100)]
    assert found(spark, [large, large[:55]], 0.55) == [(0, 1, 0.55)]


def test_copies_are_compared_once(spark, monkeypatch):
    """400 copies of two near sets: what is compared are two sets, the pairs are made afterwards."""
    seen = []
    plainly = cluster.set_pairs
    monkeypatch.setattr(cluster, "set_pairs", lambda sets, least: seen.append(sets.count()) or plainly(sets, least))
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, "abcde"))).otherwise(F.array(*map(F.lit, "edcbaf"))).alias("w"))
    assert cluster.token_pairs(df, "k", "w", 0.65).count() == 400 * 399 // 2 and seen == [2]
