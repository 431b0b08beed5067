"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random lines.  Two vectors with cosine >= t differ by at most sqrt(2 - 2t), so on
a line they differ by a normal of sd sqrt((2 - 2t) / dimension).  One line alone hardly separates: its window holds a third of a label.
So lines are first taken together: a table is a tuple of lines, each cut into steps of STEP sd; a vector's cell in
a table is the tuple of its steps.  Vectors meet where they share a cell, in as many tables as the chance to miss a true pair allows, each with so
many lines that unlike vectors rarely meet: work and shuffle follow the rows, not their pairs.  Where vectors meet, a line is sorted,
a query-centred window is a range of ranks, and the lines in whose window of WINDOW sd a pair collides are counted; pairs that reach the
recall-calibrated count are verified by cosine in double precision, and counted in the first table they share only.
Equal vectors are one row with a count.  Crowded cells are cut to pairs of parts of at most BLOCK rows, so that
no label, cell or group has to fit one task; only counts and a spanning forest leave it, never all pairs.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ann import _matrix, usable
from tessera.llm.components import connected_components
from tessera.llm.minhash import _grouped
from tessera.llm.store import batches, durable
from tessera.llm.textual import mix

LINES, WINDOW, STEP = 24, 2.2, 6.0
#: Window of the line by which pairs are listed, in sd: beyond it lie fewer than MISS.
WIDE = 4.5
#: Chance to miss a true pair by the count, and by the cells.
MISS, MISS_CELLS = 1e-5, 1e-4
#: Unlike vectors that a vector may expect to meet in a cell of one table.
MATES = 0.05
BLOCK = 1024


@cache
def directions(dimension: int, lines: int = LINES, seed: int = 9) -> np.ndarray:
    """Random unit vectors, orthogonal where the dimension allows (their collisions are then less dependent); made once per process."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    while len(out) < lines:
        q, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        out += list(q.T)
    return np.array(out[:lines])


def tables(n: int, sd: float) -> tuple[int, int]:
    """(lines of a table, tables) for labels of n vectors.

    A true pair shares a step with chance 1 - E|difference| / STEP sd, at least; directions at random fall in one with a chance of about the step's
    width over that of their spread (1 / sqrt(dimension), as is the unit of all widths here).
    """
    near = 1 - math.sqrt(2 / math.pi) / STEP
    width = STEP * sd
    far = min(0.95, math.erf(width / 2) - (1 - math.exp(-(width**2) / 4)) / (width / 2 * math.sqrt(math.pi)))
    k = max(1, math.ceil(math.log(max(n, 2) / MATES) / -math.log(far)))
    return k, math.ceil(math.log(MISS_CELLS) / math.log(1 - near**k))


def cells(unit: np.ndarray, k: int, count: int, sd: float) -> np.ndarray:
    """Hashes [rows, count] of the cells of unit vectors."""
    d = unit.shape[1]
    shift = np.random.Generator(np.random.PCG64(17)).random(k * count)
    step = np.floor(unit @ directions(d, k * count, 10).T * (math.sqrt(d) / (STEP * sd)) + shift).astype(np.int64).astype(np.uint64).reshape(len(unit), count, k)
    h = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(unit), 1))
    for j in range(k):
        h = mix(h + step[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
    return h.astype(np.int64)


def needed(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a true pair at the threshold fails to reach with probability at most `miss`."""
    p = math.erf(window / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def collisions(group: np.ndarray, lines: np.ndarray, width: float, wide: float, least: int):
    """Pairs (i, j) of the same group that collide in the windows of at least `least` lines, some at a time.

    The first line is sorted within groups, and every query's window of `wide` is a range of it; of these pairs the windows of `width` of all lines are counted.
    """
    order = np.lexsort((lines[:, 0], group))
    _, at = np.unique(group[order], return_inverse=True)
    line = 4.0 * at + lines[order, 0]  # projections lie in -1 .. 1
    until = np.searchsorted(line, line + wide, "right")
    many = until - np.arange(len(line)) - 1
    a, done = 0, np.cumsum(many)
    while a < len(line):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + (1 << 16), "right")))
        i = np.repeat(np.arange(a, b), many[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(done[a:b] - many[a:b] - (done[a - 1] if a else 0), many[a:b])
        i, j = order[i], order[j]
        hit = (np.abs(lines[i] - lines[j]) <= width).sum(axis=1) >= least
        yield i[hit], j[hit]
        a = b


def _linked(t: pa.Table, at: np.ndarray, unit: np.ndarray, k: int, count: int, sd: float, threshold: float):
    """Verified links in the blocks of t's rows `at`: (rows, their vec_ids, rows linked with each, a vec_id of its group).

    side: 0 where a block is compared with itself, else 1 and 2.  A pair that already meets in an earlier table is left to that.
    """
    block, table, side, row, vec, n = (t.column(c).to_numpy()[at] for c in ("block", "table", "side", "row", "vec_id", "n"))
    own = cells(unit, k, count, sd)
    width = sd / math.sqrt(unit.shape[1])
    a, b = [], []
    for i, j in collisions(block, unit @ directions(unit.shape[1]).T, WINDOW * width, WIDE * width, needed()):
        hit = ((side[i] == 0) | (side[i] != side[j])) & (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold)
        i, j = i[hit], j[hit]
        first = (own[i] == own[j]).argmax(axis=1) == table[i]
        a.append(i[first])
        b.append(j[first])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    links = (np.bincount(i, n[j], minlength=len(row)) + np.bincount(j, n[i], minlength=len(row))).astype(np.int64)
    # Each linked row points to the least row linked with it; repeated until nothing changes, that is a spanning forest's roots.
    root = np.arange(len(row))
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new[root]
    some = np.flatnonzero(links)
    return row[some], vec[some], links[some], vec[root[some]]


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array):
    """(places, unit vectors) of the vectors of each length."""
    size = column.value_lengths().to_numpy()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, _unit(column.take(pa.array(at)))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Rows are compared when their labels are equal and not null; a vector that is null, zero, has null or non-finite components or
    another length links with nothing of this length.  n_links counts other rows linked directly; repeated vec_ids are rows of their
    own, but share their links in component_id, which is the smallest vec_id reachable.  A null vec_id stands alone.  Other columns are ignored.
    A pair at the threshold is missed with a chance of about MISS + MISS_CELLS; links are verified, so none is false.
    """
    spark = vectors.sparkSession
    sd = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), "embedding")
    rows = durable(rows, "rows")
    some = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    v = F.col("embedding").cast("array<double>")
    some = some.select("row", "vec_id", F.xxhash64("label", F.size("embedding")).alias("label"), F.xxhash64(v).alias("f1"), F.xxhash64(F.lit(1), v).alias("f2"))
    some = durable(some, "fingerprints")
    same = ["label", "f1", "f2"]
    reps = durable(some.groupBy(*same).agg(F.min_by(F.struct("row", "vec_id"), F.struct("vec_id", "row")).alias("r"), F.count("*").alias("n")).select(*same, "r.*", "n"), "distinct")
    largest = reps.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    k, count = tables(largest, sd)
    full = rows.select("row", v.alias("embedding"))

    def placed(stream):
        for batch in stream:
            row, of = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            for at, unit in _by_length(batch.column(2)):
                cell = mix(cells(unit, k, count, sd).astype(np.uint64) ^ of[at, None]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[at], count)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(at))), pa.array(cell.ravel())], names=["row", "table", "cell"])

    with batches(spark, 2048):
        keys = durable(full.join(reps.select("row", "label"), "row").select("row", "label", "embedding").mapInArrow(placed, "row long, table int, cell long"), "cells")
    crowd = keys.groupBy("table", "cell").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.when(F.col("size") > BLOCK, F.ceil(F.col("size") / (BLOCK // 2))).otherwise(1).cast("int")
    own = keys.join(crowd.withColumn("parts", parts), ["table", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "row"), F.col("parts")).cast("int"))
    part = F.col("part")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j"), F.when(part == j, 0).when(part < j, 1).otherwise(2).alias("side")))
    met = own.select("row", "table", "cell", F.explode(pairs).alias("p")).select(F.xxhash64("table", "cell", "p.i", "p.j").alias("block"), "table", F.col("p.side").alias("side"), "row")
    met = met.join(reps.select("row", "vec_id", "n"), "row").join(full, "row").select("block", "table", "side", "row", "vec_id", "n", "embedding")
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block")

    def run(stream):
        for t in _grouped(stream, 0):
            for at, unit in _by_length(t.column("embedding").combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _linked(t, at, unit, k, count, sd, threshold)], names=["row", "vec_id", "n", "to"])

    with batches(spark, 2048):
        found = durable(dealt.mapInArrow(run, "row long, vec_id long, n long, to long"), "links")
    links = found.groupBy("row").agg(F.sum("n").alias("others"))
    of = durable(reps.join(links, "row", "left").select(*same, F.col("vec_id").alias("first"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "counts")
    members = durable(some.join(of, same).select("row", "vec_id", "first", "n_links"), "members")
    edges = found.select("vec_id", F.col("to")).unionByName(members.select("vec_id", F.col("first").alias("to")))
    component = connected_components(edges.where("vec_id <> to").distinct(), "vec_id", "to")
    out = rows.select("row", "vec_id").join(members.select("row", "n_links"), "row", "left").join(component, F.col("vec_id") == F.col("node"), "left")
    smallest = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), smallest.alias("component_id"), F.coalesce(F.col("vec_id") == smallest, F.lit(True)).alias("kept"))
