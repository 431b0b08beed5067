"""A plane on which near rows lie near: a graph of nearest neighbours, laid out by attraction along its edges and repulsion of drawn rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import density, near
from tessera.storage import stored

#: Curve of attraction for a least distance of 0.1; rows of a block, drawn rows for each edge.
A, B = 1.577, 0.895
BLOCK, DRAWN = 4096, 5
#: Times that blocks are dealt anew, and steps inside a block in between.
ROUNDS, STEPS = 6, 40


def graph(rows: DataFrame, key: str, vector: str, neighbours: int = 15) -> DataFrame:
    """(src, dst, weight), both ways: how sure it is that two rows are near, from each one's own distances to its neighbours.

    A row's nearest has weight 1; the others fall off so that the weights add up to log2 of the neighbours; the two directions are joined as a probabilistic or.
    """
    found = near.nearest(rows, key, vector, neighbours)
    own = found.groupBy("src").agg(F.array_sort(F.collect_list(F.struct((1 - F.col("similarity")).alias("d"), "dst"))).alias("n"))  # `neighbours` rows at most
    kind = dict(rows.dtypes)[key]

    def weighed(stream):
        for batch in stream:
            src, dst, weight = [], [], []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = np.maximum(np.array([x["d"] for x in n]), 0)
                lo, hi = 1e-9, 1e3
                for _ in range(60):
                    mid = (lo * hi) ** 0.5
                    lo, hi = (mid, hi) if np.exp(-(d - d[0]) / mid).sum() < np.log2(max(len(d), 2)) else (lo, mid)
                src += [k] * len(n)
                dst += [x["dst"] for x in n]
                weight += np.exp(-(d - d[0]) / hi).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, batch.column(0).type), pa.array(dst, batch.column(0).type), pa.array(weight, pa.float64())], names=["src", "dst", "weight"])

    one = own.mapInArrow(weighed, f"src {kind}, dst {kind}, weight double")
    both = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("p"), F.min("weight").alias("q"), F.count("*").alias("n"))
    both = both.select("a", "b", F.when(F.col("n") > 1, F.col("p") + F.col("q") - F.col("p") * F.col("q")).otherwise(F.col("p")).alias("weight"))
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(both.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def moved(own: np.ndarray, src: np.ndarray, dst: np.ndarray, far: np.ndarray, weight: np.ndarray, speed: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of a block's rows after len(speed) steps; dst >= 0 names a row of the block, else its place is far and stays.

    All edges pull at once, weighted; each is answered by DRAWN rows of the block that push its source away.
    """
    y = own.copy()
    inside = dst >= 0
    pull = np.bincount(src, weight, len(y))[:, None]
    for step in speed.tolist():
        there = np.where(inside[:, None], y[np.maximum(dst, 0)], far)
        gap = y[src] - there
        d2 = (gap**2).sum(axis=1)
        force = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0) * weight
        move = np.zeros_like(y)
        np.add.at(move, src, np.clip(force[:, None] * gap, -4, 4))
        for _ in range(DRAWN):
            other = rng.integers(0, len(y), len(y))
            gap = y - y[other]
            d2 = (gap**2).sum(axis=1)
            push = np.where(other != np.arange(len(y)), 2 * B / ((0.001 + d2) * (1 + A * d2**B)), 0)
            move += np.clip(push[:, None] * gap, -4, 4) * pull
        y += step * move / np.maximum(pull, 1)
    return y


def plane(rows: DataFrame, key: str, vector: str, neighbours: int = 15, seed: int = 11) -> DataFrame:
    """(key, x, y): the layout of rows (key, vector; keys distinct).  The same rows give the same places.

    It starts from the principal components, rounded so that no order of summation shows.  Each round deals rows to blocks by a hash of key and round; a block moves its own rows against each other
    and towards the places that its edges' other ends had, so no task holds more than a block and its edges.  Rows without a neighbour keep their start.
    """
    kind = dict(rows.dtypes)[key]
    start = density.plane(rows, key, vector)
    wide = start.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    scale = round(10 / max(*(w or 0.0 for w in wide), 1e-12), 4)
    now = stored(start.select(F.col(key).alias("k"), F.round(F.col("x") * scale, 6).alias("x"), F.round(F.col("y") * scale, 6).alias("y")), "places")
    many = now.count()
    if many < 3:
        return now.withColumnRenamed("k", key)
    edges = stored(graph(rows, key, vector, min(neighbours, many - 1)), "neighbours")
    blocks = -(-many // BLOCK)

    for turn in range(ROUNDS):
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "k"), F.lit(blocks))
        ends = edges.join(now.select(F.col("k").alias("dst"), "x", "y"), "dst").withColumnRenamed("src", "k")
        none = F.lit(None).cast(kind)
        dealt = now.select(block.alias("block"), F.lit(0).alias("edge"), "k", none.alias("dst"), F.lit(0.0).alias("weight"), "x", "y")
        dealt = dealt.unionByName(ends.select(block.alias("block"), F.lit(1).alias("edge"), "k", "dst", "weight", "x", "y"))

        def laid(stream, turn=turn):
            for t in near.whole(stream):
                edge = t.column("edge").to_numpy() == 1
                keys, place = np.array(t.column("k").to_pylist(), object), np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], 1)
                number = {k: i for i, k in enumerate(keys[~edge])}
                src = np.fromiter((number[k] for k in keys[edge]), np.int64)
                dst = np.fromiter((number.get(k, -1) for k in np.array(t.column("dst").to_pylist(), object)[edge]), np.int64)
                done = (turn * STEPS + np.arange(STEPS)) / (ROUNDS * STEPS)
                rng = np.random.Generator(np.random.PCG64([seed, turn, int(t.column("block")[0].as_py())]))
                y = moved(place[~edge], src, dst, place[edge], t.column("weight").to_numpy()[edge], 1.0 - done, rng)
                yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().filter(pa.array(~edge)), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["k", "x", "y"])

        now = stored(dealt.repartition(min(blocks, 10_000), "block").sortWithinPartitions("block", "edge", "k", "dst").mapInArrow(laid, f"k {kind}, x double, y double"), "places")
    return now.withColumnRenamed("k", key)
