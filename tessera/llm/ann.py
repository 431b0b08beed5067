"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of BOOKS codewords of the full dimension, chosen by beam search over residual codebooks,
and stored as that many bytes with the norm of what the sum leaves over.  A query's inner products with all codewords are
tabulated once; a code's score is a sum of table entries.  By Cauchy-Schwarz the true score is within |query| * |left over| of it, so each
code has a lower and an upper bound: every vector whose upper bound reaches the top-th lower bound of its block is scored again on
the original, and no true neighbour is lost, however many copies or near copies there are.  A coarse partition into cells lets the same kind of bound
rule out whole cells.  Codebooks and cells are fitted on a bounded sample by hash (FIT rows, a documented parameter); every vector is encoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import batches, durable

BOOKS, WORDS, BEAM = 32, 256, 4
FIT = 16_384
#: Vectors of a code block and queries of a query block.
CODES, QUERIES = 8192, 512
#: Cells at most, and the share (one of so many) that a query searches before bounds rule cells out.
CELLS, PROBED = 1024, 16


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.append(0, np.cumsum(n)[:-1]), len(x) - 1), axis=0)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        centre[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return centre


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimension): each the k-means centres of what the ones before leave over."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        out.append(k_means(rest, words, rng))
        c = out[-1]
        rest = rest - c[np.argmax(rest @ c.T - (c**2).sum(axis=1) / 2, axis=1)]
    return np.array(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes uint8 [n, books], squared norms of the approximations), by beam search: the `beam` best sums survive each book."""
    n = len(x)
    x = x.astype(np.float32)
    sums, codes = np.zeros((n, 1, x.shape[1]), np.float32), np.zeros((n, 1, 0), np.uint8)
    for c in books:
        rest = x[:, None] - sums
        # Distance after adding word w: |rest|^2 - 2 rest.w + |w|^2
        cost = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ c.T + (c**2).sum(axis=1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        from_, word = best // len(c), best % len(c)
        rows = np.arange(n)[:, None]
        sums = sums[rows, from_] + c[word]
        codes = np.concatenate([codes[rows, from_], word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin(((x[:, None] - sums) ** 2).sum(axis=2), axis=1)
    pick = np.arange(n)
    return codes[pick, best], (sums[pick, best].astype(np.float64) ** 2).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def left_over(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Norms, in double precision, of what the sums of codewords leave of x."""
    rest = x.astype(np.float64)
    for m in range(codes.shape[1]):
        rest = rest - books[m][codes[:, m]]
    return np.sqrt((rest**2).sum(axis=1)) * (1 + 1e-9) + 1e-12 * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _best(ids: np.ndarray, s: np.ndarray, bound: np.ndarray, vectors: np.ndarray, v: np.ndarray, other: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(negative exact scores, ids) of the `top` best of the `other` rows.  s: estimates that are off by at most bound; where either is not a number, the row is scored."""
    low, high = np.where(np.isfinite(s - bound), s - bound, -np.inf), s + bound
    low[~other] = -np.inf
    cut = np.partition(low, len(low) - top)[len(low) - top] if len(low) > top else -np.inf
    on = np.flatnonzero(other & ~(high < cut))
    # Term by term, so that equal vectors get equal scores.
    score, x = np.zeros(len(on)), np.ascontiguousarray(vectors[on].T).astype(np.float64)
    for a, b in zip(x, v, strict=True):
        score += a * b
    first = np.lexsort((ids[on], -score))[:top]
    return -score[first], ids[on][first]


def _cell_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it) of each row."""
    with np.errstate(all="ignore"):
        cell = np.argmin(np.nan_to_num((centres**2).sum(axis=1) - 2 * x @ centres.T, nan=np.inf), axis=1)
        return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def neighbours(vectors: DataFrame, query: Column, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) where `query` holds, its nearest by inner product.

    The query's own row is no candidate; scores are exact, in double precision on the original vectors; ties go to the smaller vec_id; fewer than `top` candidates: all.  Vectors that are not usable(),
    of another length than most, or without a vec_id take no part.  Rows that repeat a vec_id are candidates each, and queries each.

    Vectors lie in cells around centres of the sample, each of one or more code blocks.  A query first searches the cells that promise most; its score at `top` then rules out every cell
    whose bound (the centre's score and |query| times the cell's radius) is below, and only the others are searched too.  So no neighbour is lost, and what has clusters is searched in part.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("_q", F.coalesce(query, F.lit(False)))
    kind = "double" if vectors.schema["embedding"].dataType.elementType.typeName() != "float" else "float"
    real = np.float64 if kind == "double" else np.float32
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), "_q")
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # row numbers that stay
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], none)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("embedding") == dim)
    n = lengths[0]["count"]
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(5), "vec_id", "row"), 11) / F.lit(2.0**53)
    fitted = rows.where(unit < min(1.0, 1.1 * FIT / n)).select("row", "embedding").limit(2 * FIT).toArrow().sort_by("row")
    sample = _matrix(fitted.column("embedding").combine_chunks())
    sample = sample if len(sample) else np.zeros((1, dim))
    books = spark.sparkContext.broadcast(fit(sample))  # BOOKS * WORDS vectors
    centres = k_means(sample, max(1, min(CELLS, n // CODES)), np.random.Generator(np.random.PCG64(4)))
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    def placed(stream):
        for batch in stream:
            cell, far = _cell_of(_matrix(batch.column("embedding")), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "embedding", "_q")), pa.array(cell.astype(np.int32)), pa.array(far)], names=["row", "vec_id", "embedding", "_q", "cell", "far"])

    with batches(spark, 4096):
        rows = durable(rows.mapInArrow(placed, f"row long, vec_id long, embedding array<{kind}>, _q boolean, cell int, far double"), "placed")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()  # CELLS rows at most
    radius = np.full(len(centres), -np.inf)
    radius[[r["cell"] for r in cells]] = [np.inf if np.isnan(r["radius"]) else r["radius"] for r in cells]
    parts = {r["cell"]: -(-r["n"] // CODES) for r in cells}
    table = spark.createDataFrame(list(parts.items()), "cell int, parts int")
    block = F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(6), "row"), F.col("parts")))

    def coded(stream):
        held: dict[int, list] = {}

        def out(name):
            columns = [np.concatenate(x) for x in zip(*held.pop(name), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0][:1]), *(pa.array([x.tobytes()], pa.binary()) for x in columns[1:])], names=["cell", "rows", "ids", "codes", "errors", "vectors"])

        for batch in stream:
            name, cell, row, ids = (batch.column(i).to_numpy() for i in range(4))
            x = _matrix(batch.column(4))
            for a in range(0, len(x), 256):
                part = x[a : a + 256]
                codes, _ = encode(part, books.value)
                errors = left_over(part, codes, books.value)
                for k in np.unique(name[a : a + 256]):
                    own = name[a : a + 256] == k
                    held.setdefault(int(k), []).append((cell[a : a + 256][own], row[a : a + 256][own], ids[a : a + 256][own], codes[own], errors[own], part[own].astype(real)))
            for k in [k for k in held if k != name[-1]]:
                yield out(k)
        for k in list(held):
            yield out(k)

    dealt = rows.join(F.broadcast(table), "cell").select(block.alias("block"), "cell", "row", "vec_id", "embedding")  # a row for each cell
    dealt = dealt.repartition(max(sum(parts.values()), 6), "block").sortWithinPartitions("block", "vec_id", "row")
    with batches(spark, 4096):
        index = durable(dealt.mapInArrow(coded, "cell int, rows binary, ids binary, codes binary, errors binary, vectors binary"), "codes")

    def searched(stream):
        largest = np.sqrt((books.value.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum()
        rounding = 2.0**-22 * (dim + len(books.value)) * largest
        for batch in stream:
            found, near = [], []
            for r in range(batch.num_rows):
                numbers, ids = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("rows", "ids"))
                codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint8).reshape(len(ids), -1)
                errors = np.frombuffer(batch.column("errors")[r].as_py(), np.float64)
                own = np.frombuffer(batch.column("vectors")[r].as_py(), real).reshape(len(ids), -1)
                q = batch.column("q")[r].values
                for qid, v in zip(q.field("row").to_pylist(), _matrix(q.field("embedding")), strict=True):
                    lookup = books.value @ v.astype(np.float32)
                    s = lookup[0][codes[:, 0]]
                    for m in range(1, codes.shape[1]):
                        s = s + lookup[m][codes[:, m]]
                    found.append(qid)
                    near.append(_best(ids, s.astype(np.float64), (errors + rounding) * np.sqrt(v @ v), own, v, numbers != qid, top))
            lens = np.append(0, np.cumsum([len(i) for _, i in near])).astype(np.int32)
            s, i = (np.concatenate([x[k] for x in near]) if near else [] for k in (0, 1))
            values = pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(i, pa.int64())], names=["s", "vec_id"])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.ListArray.from_arrays(pa.array(lens), values)], names=["query_row", "near"])

    def search(asked: DataFrame) -> DataFrame:
        """(query_row, near) for queries (row, embedding, cell): groups of QUERIES meet every block of their cell."""
        asked = durable(asked, "asked")
        size = durable(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "groups")
        met_blocks = sum(r["groups"] * parts[r["cell"]] for r in size.collect())  # CELLS rows at most
        group = F.pmod(F.xxhash64(F.lit(7), "row"), F.col("groups"))
        q = asked.join(F.broadcast(size), "cell").groupBy("cell", group.alias("group")).agg(F.collect_list(F.struct("row", "embedding")).alias("q"))  # a row for each cell
        met = index.join(q, "cell").select("group", "rows", "ids", "codes", "errors", "vectors", "q")
        met = met.repartition(max(6, min(met_blocks, 10_000)), "group", F.xxhash64("rows"))
        with batches(spark, 8):
            return durable(met.mapInArrow(searched, "query_row long, near array<struct<s: double, vec_id: long>>"), "nearest")

    probes = max(1, -(-len(centres) // PROBED))

    def asking(first: bool):
        def run(stream):
            for batch in stream:
                x = _matrix(batch.column("embedding"))
                with np.errstate(all="ignore"):
                    length, mid = np.sqrt((x * x).sum(axis=1)), x @ shared.value.T
                    promise = np.nan_to_num(mid + length[:, None] * np.where(np.isfinite(radius), radius, 0) / np.sqrt(dim), nan=np.inf)
                    promise[:, ~(radius > -np.inf)] = -np.inf
                    pick = np.zeros(mid.shape, bool)
                    pick[np.arange(len(x))[:, None], np.argsort(-promise, axis=1, kind="stable")[:, :probes]] = True
                    pick &= radius > -np.inf
                    if not first:
                        cut = np.array([-np.inf if c is None else c for c in batch.column("cut").to_pylist()])
                        bound = mid + length[:, None] * radius * (1 + 1e-9)
                        slack = 1e-9 * (np.abs(mid) + np.abs(bound)) + 1e-300
                        pick = ~pick & (radius > -np.inf) & ~(bound + slack < cut[:, None])
                i, cell = np.nonzero(pick)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(i)), batch.column("embedding").take(pa.array(i)), pa.array(cell.astype(np.int32))], names=["row", "embedding", "cell"])

        return run

    schema = f"row long, embedding array<{kind}>, cell int"
    queries = rows.where("_q").select("row", "embedding")
    with batches(spark, 1024):
        lists = search(queries.mapInArrow(asking(True), schema))
        if len(cells) > probes:
            kth = lists.groupBy("query_row").agg(F.get(F.array_sort(F.flatten(F.collect_list("near"))), F.lit(top - 1))["s"].alias("s"))
            known = queries.join(kth, queries.row == kth.query_row, "left").select("row", "embedding", (-F.col("s")).alias("cut"))
            lists = lists.unionByName(search(known.mapInArrow(asking(False), schema)))
    # s is the negative score, so ascending order is by falling score, then by vec_id.
    ranked = lists.groupBy("query_row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, top).alias("near"))
    ranked = ranked.join(rows.where("_q").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
    out = ranked.select("query_id", F.posexplode("near").alias("p", "n"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.s")).alias("score"))
