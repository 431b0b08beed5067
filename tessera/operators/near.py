"""Near vectors without all pairs: rows are sorted along random projections, and meet those that stand beside them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

#: Rows that stand together in a stretch; sorted orders that each row takes part in.
STRETCH, ORDERS = 256, 12


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of an array column; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def placed(rows: DataFrame, key: str, vector: str, group: str | None = None, orders: int = ORDERS, stretch: int = STRETCH, seed: int = 7) -> DataFrame:
    """(place, key, vector): each row once for each of `orders` random orders, under the stretch of that order in which it stands.

    An order sorts by the signs of random projections, as many as leave about half a stretch of rows to a sign pattern, then by one more projection;
    vectors that are near in angle come to stand near in most orders.  Stretches hold `stretch` rows each, the last of a group fewer; only rows of one
    group (default: all) share one.  The same rows make the same stretches.  Keys must be distinct; rows with a null key, vector or group are left out.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    own = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g")).where("k is not null and v is not null and g is not null")
    many = own.count()
    bits = max(0, min(48, int(np.ceil(np.log2(max(many, 1) * 2 / stretch)))))

    def projected(stream):
        planes: dict[int, np.ndarray] = {}
        for batch in stream:
            x = matrix(batch.column(1))
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.Generator(np.random.PCG64(seed)).standard_normal((orders, bits + 1, d))
            at = np.einsum("nd,obd->nob", x, planes[d])
            sign = (at[:, :, :bits] > 0).astype(np.int64)
            code = np.zeros(sign.shape[:2], np.int64)
            for b in range(bits):  # Gray code: neighbours in the order differ in few signs
                code = code * 2 + (sign[:, :, b] ^ (code & 1))
            n = len(x)
            take = pa.array(np.repeat(np.arange(n), orders))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(np.tile(np.arange(orders, dtype=np.int32), n)), pa.array(code.ravel()), pa.array(at[:, :, bits].ravel())], names=["k", "g", "o", "code", "at"])

    order = ["o", "g", "code", "at", "k"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = own.mapInArrow(projected, f"k {kinds[key]}, g {kinds[group] if group else 'int'}, o int, code long, at double").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = stored(ranked.select("o", "g", "k", F.monotonically_increasing_id().alias("id")), "ranked")
    # Ranks in an order and group: what stands before in its task, and in the tasks before (a row for each of an order's groups and tasks).
    part = F.shiftright("id", 33)
    runs = ranked.groupBy("o", "g", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("o", "g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.col("id") - F.col("first") + F.col("before")
    ranked = ranked.withColumn("part", part).join(runs, ["o", "g", "part"]).select("k", F.xxhash64("o", "g", F.floor(rank / stretch)).alias("place"))
    return ranked.join(own.select("k", "v"), "k").select("place", "k", "v").repartition(n, "place").sortWithinPartitions("place", "k")


def stretches(stream):
    """(keys, unit vectors) of each stretch of placed(), as its sorted partitions come."""
    rest: list[pa.RecordBatch] = []

    def made():
        t = pa.Table.from_batches(rest)
        return t.column(1).to_pylist(), matrix(t.column(2))

    for batch in stream:
        place = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else []
        for a, b in zip(first, [*first[1:], len(place)], strict=True):
            if rest and rest[-1].column(0)[0].as_py() != place[a]:
                yield made()
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield made()


def nearest(rows: DataFrame, key: str, vector: str, top: int, **how) -> DataFrame:
    """(src, dst, similarity): the `top` rows of largest cosine found for each row; ties: the least key.  No row is its own neighbour; every pair met is scored exactly."""
    kind = dict(rows.dtypes)[key]

    def met(stream):
        for keys, x in stretches(stream):
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            most = min(top, len(keys) - 1)
            if most < 1:
                continue
            by = np.argsort(-s, axis=1, kind="stable")[:, :most]
            a = np.repeat(np.arange(len(keys)), most)
            src, dst = ([keys[i] for i in z] for z in (a.tolist(), by.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(s[a, by.ravel()])], names=["src", "dst", "similarity"])

    found = placed(rows, key, vector, **how).mapInArrow(met, f"src {kind}, dst {kind}, similarity double").where("src <> dst")
    found = found.groupBy("src", "dst").agg(F.max(F.round("similarity", 9)).alias("similarity"))
    # At most ORDERS * top rows for a row.
    best = found.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "dst"))), 1, top).alias("n"))
    return best.select("src", F.explode("n").alias("n")).select("src", "n.dst", (-F.col("n.s")).alias("similarity"))


def similar(rows: DataFrame, key: str, vector: str, least: float, group: str | None = None, **how) -> DataFrame:
    """(a, b, similarity): pairs a < b (of one group) of cosine >= least that some order brought together; scored exactly."""
    kind = dict(rows.dtypes)[key]

    def met(stream):
        for keys, x in stretches(stream):
            i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
            s = np.einsum("nd,nd->n", x[i], x[j])
            a, b = [keys[z] for z in i.tolist()], [keys[z] for z in j.tolist()]
            low, high = [min(p) for p in zip(a, b, strict=True)], [max(p) for p in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(low, _arrow(kind)), pa.array(high, _arrow(kind)), pa.array(s)], names=["a", "b", "similarity"])

    found = placed(rows, key, vector, group, **how).mapInArrow(met, f"a {kind}, b {kind}, similarity double")
    return found.where("a < b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def whole(stream):
    """One table for each block of a stream sorted by its first column."""
    rest: list[pa.RecordBatch] = []
    for batch in stream:
        block = batch.column(0).to_numpy()
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for a, b in zip(first, [*first[1:], len(block)], strict=True):
            if rest and rest[-1].column(0)[0].as_py() != block[a]:
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()
