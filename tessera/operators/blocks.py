"""Exact cosines of all pairs of a group's rows: a group is cut into parts, each pair of parts is a block that one task multiplies, and a block is compared a stretch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import near

#: Rows of a part; cosines that a task holds at once.
SIDE, CELLS = 4096, 1 << 20
#: Products of matrices differ from sums in order by less; what lies as near to a limit is summed in order again.
SLACK = 1e-9


class Rows:
    """A block's rows in order of their keys: places of keys, and cosines as vectors.cosine has them."""

    def __init__(self, keys: pa.Array, vectors: pa.Array):
        self.keys = keys
        new = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)
        self.place = np.concatenate([[0], np.cumsum(new)])[: len(keys)]
        self.size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        whole = np.ones(len(keys), bool)  # without null elements
        values, width = vectors.flatten(), max(int(self.size.max(initial=0)), 1)
        if values.null_count:
            whole[np.unique(pc.list_parent_indices(vectors).to_numpy()[values.is_null().to_numpy(zero_copy_only=False)])] = False
        self.x = np.zeros((len(keys), width))
        self.x[np.arange(width) < self.size[:, None]] = values.fill_null(0).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)
        self.known, self.norm = whole & (self.size >= 0), np.sqrt(_summed(self.x, self.x))
        self.unit = self.x / np.where(self.norm == 0, 1, self.norm)[:, None]
        self.plain = bool(self.known.all()) and bool((self.size == width).all()) and bool(np.isfinite(self.unit).all())

    def cosines(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Cosines of rows i with rows j within SLACK, and which of them are null (None: none is)."""
        with np.errstate(invalid="ignore", over="ignore"):
            s = self.unit[i] @ self.unit[j].T
        if self.plain:
            return s, None
        a, b = self.size[i][:, None], self.size[j][None, :]
        other = (a != b) & (a >= 0) & (b >= 0)
        s[other] = -1.0
        if (odd := np.nonzero(~np.isfinite(s)))[0].size:
            s[odd] = self.summed(i[odd[0]], j[odd[1]])
        return s, ~other & ~(self.known[i][:, None] & self.known[j][None, :])

    def summed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of pairs, summed in order."""
        norm = self.norm[i] * self.norm[j]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            s = np.where(norm == 0, 0.0, _summed(self.x[i], self.x[j]) / norm)
        return np.where((self.size[i] != self.size[j]) & (self.size[i] >= 0) & (self.size[j] >= 0), -1.0, s)

    def rounded(self, s: np.ndarray, i: np.ndarray, j: np.ndarray, digits: int, of: Callable = lambda s: s) -> np.ndarray:
        """of(cosine) rounded as SQL rounds it, half away from zero."""
        scale = 10.0**digits
        y = of(s) * scale
        with np.errstate(invalid="ignore"):
            out = np.floor(y + 0.5) / scale
            close = np.nonzero(np.abs(y - np.floor(y) - 0.5) < scale * SLACK)[0]
        if len(close):
            exact, unit = of(self.summed(i[close], j[close])), Decimal(1).scaleb(-digits)
            out[close] = [float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) if np.isfinite(v) else v for v in exact]
        return out + 0.0


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[:, d]
    return out


def _dealt(rows: DataFrame, side: int) -> DataFrame:
    """rows (g, k, v) with the part they are dealt to and how many parts their group has."""
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    return rows.join(parts, "g").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "k"), F.col("parts")).cast("int"))


def _read(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    return rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).where("g is not null and k is not null")


def _blocks(dealt: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run on each block's rows (block, k, side, v), which come in order of k."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(max(n, 200), "block").sortWithinPartitions("block", "k")

    def each(stream):
        for t in near.whole(stream):
            yield from run(t)

    return blocks.mapInArrow(each, schema)


def _whole(t: pa.Table, name: str) -> pa.Array:
    column = t.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def pairs(rows: DataFrame, group: str, key: str, vector: str, name: str, digits: int = 4, least: float | None = None, of: Callable = lambda s: s, side: int = SIDE) -> DataFrame:
    """(a, b, name): of all pairs a < b of a group, of(cosine) rounded; with `least`, of those from that cosine only.

    Every row meets every row of its group, so time follows the square of a group; a row is shuffled once for each part of its group, and no task holds more than a block.
    """
    kind = dict(rows.dtypes)[key]
    dealt = _dealt(_read(rows, group, key, vector), side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    mark = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("g", low, high).alias("block"), "k", mark.alias("side"), "v")

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        r, mark = Rows(_whole(t, "k"), _whole(t, "v")), t.column("side").to_numpy()
        alone = not len(mark) or mark[0] == 0
        left = np.arange(len(mark)) if alone else np.flatnonzero(mark == 1)
        right = left if alone else np.flatnonzero(mark == 2)
        step = max(1, CELLS // max(len(right), 1))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            s, null = r.cosines(i, right)
            met = r.place[right][None, :] > r.place[i][:, None] if alone else r.place[right][None, :] != r.place[i][:, None]
            if least is not None:
                near_ = (s >= least - SLACK) | np.isnan(s)
                met &= near_ if null is None else near_ & ~null
            x, y = np.nonzero(met)
            values, none = s[x, y], None if null is None else null[x, y]
            x, y = i[x], right[y]
            if least is not None:
                edge = np.abs(values - least) <= SLACK
                values[edge] = r.summed(x[edge], y[edge])
                good = (values >= least) | np.isnan(values)  # Spark holds NaN for the largest
                x, y, values, none = x[good], y[good], values[good], None if none is None else none[good]
            values = r.rounded(values, x, y, digits, of)
            for cut in range(0, len(x), 1 << 16):
                a, b = x[cut : cut + (1 << 16)], y[cut : cut + (1 << 16)]
                first, second = pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))
                mask = None if none is None else none[cut : cut + (1 << 16)]
                yield pa.RecordBatch.from_arrays([r.keys.take(first), r.keys.take(second), pa.array(values[cut : cut + (1 << 16)], pa.float64(), mask=mask)], names=["a", "b", name])

    return _blocks(dealt, run, f"a {kind}, b {kind}, {name} double")


def nearest(rows: DataFrame, probes: DataFrame, group: str, key: str, probe: str, vector: str, top: int, digits: int = 6, side: int = SIDE) -> DataFrame:
    """(probe, key, similarity): for each probe's row and part of its group, the `top` rows of largest rounded cosine (ties: the least key); a probe does not meet its own key.

    The best of all parts are among them.  rows and probes have group and vector; keys of rows and probes are of one kind.
    """
    kind = dict(rows.dtypes)[key]
    mine = _dealt(_read(rows, group, key, vector), side)
    parts = mine.select("g", "parts").distinct()
    asks = _dealt(_read(probes, group, probe, vector), side).drop("parts").withColumnRenamed("own", "part").join(parts, "g")
    asked = asks.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    among = asks.groupBy("g").agg((F.max("part") + 1).alias("many"))
    mine = mine.join(among, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    block = F.xxhash64("g", "own", "part").alias("block")
    dealt = asked.select(block, "k", F.lit(1).alias("side"), "v").unionByName(mine.select(block, "k", F.lit(2).alias("side"), "v"))

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        r, mark = Rows(_whole(t, "k"), _whole(t, "v")), t.column("side").to_numpy()
        left, right = np.flatnonzero(mark == 1), np.flatnonzero(mark == 2)
        places, step = r.place[right], max(1, CELLS // max(len(right), 1))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            s, null = r.cosines(i, right)
            s = np.where(np.isnan(s), np.inf, s)  # Spark holds NaN for the largest, null for the least
            if null is not None:
                s[null] = -np.inf
            s[places[None, :] == r.place[i][:, None]] = np.nan
            out: list[tuple] = []
            for n, p in enumerate(i.tolist()):
                there = np.flatnonzero(~np.isnan(s[n]))
                row = s[n][there]
                if len(row) > top:
                    kth = np.partition(row, len(row) - top)[len(row) - top]
                    keep = row >= kth - 2 * 10.0**-digits
                    there, row = there[keep], row[keep]
                j = right[there]
                value = r.rounded(row, np.full(len(j), p), j, digits)
                best = np.lexsort((places[there], -value))[:top]
                out.append((np.full(len(best), p), j[best], value[best]))
            a, b, v = (np.concatenate(z) if out else np.zeros(0, int) for z in (zip(*out, strict=True) if out else ((), (), ())))
            v = np.where(v == np.inf, np.nan, v)
            yield pa.RecordBatch.from_arrays([r.keys.take(pa.array(a)), r.keys.take(pa.array(b)), pa.array(v, pa.float64(), mask=v == -np.inf)], names=["probe", "key", "similarity"])

    return _blocks(dealt, run, f"probe {kind}, key {kind}, similarity double")
