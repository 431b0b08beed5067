"""MinHash near-duplicates: banding proposes, odd sketches screen, full shingle sets confirm.

Plan.  (1) One pass over the texts gives each document its set size, a 128-bit fingerprint of the set,
band keys and an odd sketch (the parities of its MinHash samples folded into a bitmap).  (2) Equal sets
become one representative by a map-side-combined groupBy.  (3) Band buckets of two or more are dealt into blocks
of at most BLOCK rows; crowded buckets are split by a salt that differs per band, with a few anchors in every block.  In a block the
XOR population count of two sketches estimates their similarity, and a spanning forest of the estimated links
is emitted, never all pairs.  In a split bucket the documents that its main component does not yet hold are then
compared with every document of it whose set size allows the similarity.  (4) The components over-cover the true links; each is compared on full
sets, again in bounded blocks with anchors.  Documents of a crowded component that its main class does not yet
hold are then compared with every block, so no link between different classes is lost to the split; where these are many (a family of
documents alike, but not enough), only pairs that share one of their rarest shingles are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.store import durable, release, scope, small_batches
from tessera.llm.textual import mix, shingle_sets

BANDS, ROWS, SAMPLES = 20, 3, 96
SKETCH_BITS = 512
#: Rows of a block, and expected anchors of a split bucket or component.
BLOCK, ANCHORS = 128, 12
#: Rows and probes of a block where a split bucket is completed.
SIDE = 1024
#: Copies of a component's texts, on average, that may be sent to meet its minor classes; beyond, rarest shingles propose the pairs.
SPREAD = 4
#: Ratio of the size classes of these, and how many pairs they may propose for a text that would be sent.
RATIO, LESS = 1.05, 1.0
#: Estimated similarity from which a banded pair goes on to the exact comparison: 5 standard errors below 0.75.
SCREEN = 0.53

_draw = np.random.Generator(np.random.PCG64(42)).integers(0, 2**63, (2, SAMPLES), dtype=np.uint64)
_A, _B = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]
_INDEX = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))


def minhash(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(best, (shingles[i : i + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Fold samples, each with its index, into a bitmap of parities (SKETCH_BITS / 64 words)."""
    bit = mix(samples ^ _INDEX) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def estimate(differing: np.ndarray | int) -> np.ndarray:
    """Similarity from the number of differing parities: E[d] = n/2 (1 - exp(-4k(1-J)/n))."""
    n, k = SKETCH_BITS, SAMPLES
    return 1 + n / (4 * k) * np.log(np.maximum(1 - 2 * np.asarray(differing) / n, 1e-9))


#: The most differing parities that the screen lets pass.
_MOST = int(np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= SCREEN)[-1])


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(shingles + np.uint64(1)).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands array<long>, sketch binary, t); empty sets have null bands and sketch; t: a hash of the text."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if not len(s):
                    rows.append((doc, 0, 0, 0, None, None, t))
                    continue
                m = minhash(s)
                keys = m[: BANDS * ROWS].reshape(BANDS, ROWS)
                key = mix(mix(mix(keys[:, 0]) + keys[:, 1]) + keys[:, 2] + _INDEX[:BANDS])
                rows.append((doc, len(s), *fingerprint(s), key.astype(np.int64).tolist(), odd_sketch(m).tobytes(), t))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list("abcdefg")) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=list("abcdefg"))

    text = F.col("text").cast("string")
    out = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, "a long, b long, c long, d long, e array<long>, f binary, g long")
    return out.toDF("doc_id", "n_shingles", "f1", "f2", "bands", "sketch", "t")


def _blocks(groups: DataFrame, key: str, size: str) -> DataFrame:
    """Deal rows (key, id, size) into blocks of about BLOCK rows; anchors of a split group stand in every block of it.

    Adds block (a hash of the group and the part) and parts.
    """
    parts = F.ceil(F.col(size) / (BLOCK - ANCHORS)).cast("int")
    g = groups.withColumn("parts", F.when(F.col(size) > BLOCK, parts).otherwise(1))
    h = F.xxhash64(F.col(key), F.lit(7), "id")
    share = F.shiftrightunsigned(h, 11) / F.lit(2.0**53)
    own = F.pmod(F.xxhash64(F.col(key), F.lit(8), "id"), F.col("parts")).cast("int")
    anchor = (F.col("parts") > 1) & (share < F.lit(float(ANCHORS)) / F.col(size))
    g = g.withColumn("part", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    return g.withColumn("block", F.xxhash64(F.col(key), F.lit(9), "part")).drop("part")


def _grouped(batches, key: int):
    """Whole groups of a stream sorted by the key column, several at a time, as record batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if len(k) and (k != k[-1]).any() else 0
        if rest and len(k) and rest[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
            rest = []
        if len(k):
            rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _forest(near, n: int, known=()) -> list[tuple[int, int]]:
    """A spanning forest of a graph of n nodes.  near(i, rest): the mask of rest that i links with."""
    out, todo, queue = [], np.arange(n), []
    while len(todo) or queue:
        if not queue:
            queue, todo = [int(todo[0])], todo[1:]
        i = queue.pop()
        if len(todo):
            hit = near(i, todo)
            out += [(i, int(j)) for j in todo[hit]]
            queue += todo[hit].tolist()
            todo = todo[~hit]
    return out


def _screened(rows: DataFrame) -> DataFrame:
    """Rows (block, id, sketch), dealt and sorted by block: a spanning forest (a, b) of the estimated links of each block."""

    def run(batches):
        for t in _grouped(batches, 0):
            block, ids = t.column("block").to_numpy(), t.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            size = np.diff(np.append(first, len(block)))
            lead = np.repeat(first, size)
            hit = np.bitwise_count(sketch ^ sketch[lead]).sum(axis=1, dtype=np.int64) <= _MOST
            a, b = [ids[lead[hit]]], [ids[hit]]
            for f, n in zip(first[(bad := np.add.reduceat(~hit, first)) > 0], size[bad > 0], strict=True):
                if n < 3:
                    continue
                part, s = ids[f : f + n], sketch[f : f + n]
                pairs = np.array(_forest(lambda i, todo, s=s: np.bitwise_count(s[todo] ^ s[i]).sum(axis=1, dtype=np.int64) <= _MOST, n), np.int64).reshape(-1, 2)
                a.append(part[pairs[:, 0]])
                b.append(part[pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _completed(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (block, id, component, size, probe, sketch), dealt and sorted by block: estimated links (a, b) of probes, one with each other component."""

    def run(batches):
        for t in _grouped(batches, 0):
            block, ids, component, size = (t.column(c).to_numpy() for c in ("block", "id", "component", "size"))
            probe = t.column("probe").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            a: list[int] = []
            b: list[int] = []
            for f, e in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
                own = f + np.flatnonzero(~probe[f:e])
                own = own[np.argsort(size[own], kind="stable")]
                least, those, theirs, whose = size[own], sketch[own], component[own], ids[own]
                for i in (f + np.flatnonzero(probe[f:e])).tolist():
                    # 100 * smaller >= percent * larger, or no similarity is enough
                    lo, hi = np.searchsorted(least, [-(-percent * size[i] // 100), 100 * size[i] // max(percent, 1) + 1])
                    near = np.bitwise_count(those[lo:hi] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= _MOST
                    near &= theirs[lo:hi] != component[i]
                    if near.any():
                        _, at = np.unique(theirs[lo:hi][near], return_index=True)
                        b += whose[lo:hi][near][at].tolist()
                        a += [int(ids[i])] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _completion(reps: DataFrame, crowd: DataFrame, loose: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of loose that share a split bucket: rows outside of a bucket's main component meet all rows of near size.

    Set sizes are cut into classes so wide that a similar pair lies in the same or adjacent ones; the rows of
    a bucket and class and those that probe it are dealt into squares of about SIDE by SIDE.
    """
    keys = reps.select("id", "f1", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    keys = keys.join(crowd.where(F.col("n") > BLOCK).select("key"), "key").join(loose.withColumnRenamed("node", "id"), "id", "left")
    step = max(float(np.log(100 / max(percent, 1))) * 1.0001, 0.01)
    keys = durable(keys.withColumn("component", F.coalesce("component", "id")).withColumn("class", F.floor(F.log("size") / step).cast("int")), "crowded")
    counts = keys.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"))
    rows = keys.join(main.where("components > 1"), "key")
    probes = rows.where("component <> main").withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
    sides = [x.groupBy("key", "class").agg(F.ceil(F.count("*") / SIDE).cast("int").alias(n)) for x, n in ((rows, "parts"), (probes, "chunks"))]
    sides = durable(sides[0].join(sides[1], ["key", "class"]), "sides")

    def dealt(x: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        at = F.pmod(F.xxhash64(F.lit(10), "key", "id", "f1"), F.col(own)).cast("int")
        x = x.join(sides, ["key", "class"]).select("key", "class", "id", "f1", "component", "size", at.alias("at"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("across"))
        square = ("across", "at") if probe else ("at", "across")
        return x.select(F.xxhash64("key", "class", *square).alias("block"), "id", "f1", "component", F.col("size").cast("long").alias("size"), F.lit(probe).alias("probe"))

    met = dealt(rows, "parts", "chunks", False).unionByName(dealt(probes, "chunks", "parts", True))
    met = met.join(reps.select("id", "f1", "sketch"), ["id", "f1"]).select("block", "id", "component", "size", "probe", "sketch")
    return _completed(_dealt(met), percent)


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (block, id, f1, f2, class, minor, text), dealt and sorted by block: exact links that join classes.

    class null: every document is its own class, and a spanning forest of each block is returned as (id, block's
    least linked id); else (a, b) for each link found between a minor row and a row of another class.
    """

    def run(batches):
        for t in _grouped(batches, 0):
            block = t.column("block").to_numpy()
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            a: list[int] = []
            b: list[int] = []
            for f, n in zip(first.tolist(), np.diff(np.append(first, len(block))).tolist(), strict=True):
                part = t.slice(f, n)
                expect = list(zip(part.column("f1").to_pylist(), part.column("f2").to_pylist(), strict=True))
                sets, ids, kind, minor, seen = [], [], [], [], set()
                for s, want, i, c, m in zip(shingle_sets(part.column("text")), expect, part.column("id").to_pylist(), part.column("class").to_pylist(), part.column("minor").to_pylist(), strict=True):
                    if (i, m) not in seen and fingerprint(s) == want:  # rows may repeat
                        seen.add((i, m))
                        sets.append(s)
                        ids.append(i)
                        kind.append(c)
                        minor.append(m)
                if len(sets) < 2:
                    continue
                sizes = np.array([len(s) for s in sets])
                at = np.append(0, np.cumsum(sizes))
                _, code = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(code.max() + 1, np.int64)

                def links(i, mark=mark, code=code, at=at, sizes=sizes):
                    mark[:] = 0
                    mark[code[at[i] : at[i + 1]]] = 1
                    both = np.add.reduceat(mark[code], at[:-1])
                    return 100 * both >= percent * (sizes + sizes[i] - both)

                if kind[0] is None:
                    root = np.arange(len(ids))
                    for i, j in _forest(lambda i, todo, links=links: links(i)[todo], len(ids)):
                        root[j] = root[i]
                    least: dict[int, int] = {}
                    for i, r in zip(ids, root.tolist(), strict=True):
                        least[r] = min(i, least.get(r, i))
                    a += ids
                    b += [least[r] for r in root.tolist()]
                else:
                    kinds = np.array(kind)
                    for i in np.flatnonzero(minor).tolist():
                        for c in np.unique(kinds[found := links(i) & (kinds != kinds[i])]):
                            a.append(ids[i])
                            b.append(ids[int(np.flatnonzero(found & (kinds == c))[0])])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame) -> DataFrame:
    """Rows (component, id, class, minor, f1, f2, text): (component, id, class, minor, shingles), once for each set."""

    def run(batches):
        for batch in batches:
            f1, f2 = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep, sets = [], []
            for k, s in enumerate(shingle_sets(batch.column(6))):
                if fingerprint(s) == (f1[k], f2[k]):
                    keep.append(k)
                    sets.append(s.astype(np.int64))
            part = batch.take(pa.array(keep, pa.int64()))
            at = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], values], names=["component", "id", "class", "minor", "shingles"])

    return rows.mapInArrow(run, "component long, id long, class long, minor boolean, shingles array<long>").dropDuplicates(["component", "id"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (component, low, apart, side, shingle, id, class, minor, x): sets under their rarest shingles; similar ones share one.

    Two sets of sizes x and y must have t / (1 + t) * (x + y) shingles in common, so they share one of the x - that + 1 rarest of x (and likewise of y).
    Sizes are cut into classes of RATIO, and each row stands under its rarest shingles once for each class that a partner may have,
    no deeper than the smallest partner there asks for: what a whole family of documents shares is met only where it must be.
    """
    t = max(percent, 1) / 100
    step = float(np.log(RATIO))
    each = sets.select("component", "id", F.explode("shingles").alias("shingle"))
    common = each.groupBy("component", "shingle").agg(F.count("*").alias("df"))
    ordered = each.join(common, ["component", "shingle"]).groupBy("component", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "shingle"))), lambda z: z["shingle"]).alias("rare"))
    x = F.col("x")
    rows = sets.select("component", "id", "class", "minor", F.size("shingles").alias("x")).join(ordered, ["component", "id"]).withColumn("c", F.floor(F.log(x) / step))
    far = int(np.ceil(-np.log(t) / step)) + 1
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(-far), F.lit(far))))
    least = F.greatest(F.floor(F.exp((F.col("c") + F.col("d")) * step)), F.ceil(x * t))
    deep = (x - F.ceil(F.lit(t / (1 + t)) * (x + least) - 1e-6) + 1).cast("int")
    rows = rows.withColumn("deep", F.least(deep, x)).where((F.col("deep") > 0) & (least * t <= x))
    keys = rows.select("component", "id", "class", "minor", "x", F.least(F.col("c"), F.col("c") + F.col("d")).alias("low"), F.abs("d").alias("apart"), F.signum("d").cast("int").alias("side"), F.explode(F.slice("rare", F.lit(1), F.col("deep"))).alias("shingle"))
    return keys


_ON = ["component", "low", "apart", "side", "shingle"]


def _turned(keys: DataFrame) -> DataFrame:
    """Minor rows as they ask: the smaller of two classes meets the larger, not its like."""
    return keys.where("minor").withColumn("side", -F.col("side"))


def _meetings(keys: DataFrame) -> DataFrame:
    """(component, met): how many pairs _probed() would look at, from counts alone."""
    asks = _turned(keys).groupBy(*_ON).agg(F.count("*").alias("asks"))
    return asks.join(keys.groupBy(*_ON).agg(F.count("*").alias("there")), _ON).groupBy("component").agg(F.sum(F.col("asks") * F.col("there")).alias("met"))


def _probed(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a minor row and one of another class that share one of their rarest shingles and whose sizes allow the similarity."""
    probes = _turned(keys).select(*_ON, F.col("id").alias("a"), F.col("class").alias("ca"), F.col("x").alias("xa"))
    met = probes.join(keys.select(*_ON, F.col("id").alias("b"), F.col("class").alias("cb"), F.col("x").alias("xb")), _ON)
    return met.where((F.col("ca") != F.col("cb")) & (100 * F.least("xa", "xb") >= percent * F.greatest("xa", "xb"))).select("a", "ca", "b", "cb").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """By block, in as many partitions as the session deals shuffles to (not merged: a task holds whole texts)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block").sortWithinPartitions("block")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Sets are linked when 100 * |A & B| >= percent * |A | B|; component_id is the smallest doc_id reachable.  Null
    or empty texts (and those of white space) have the empty set and link with nothing.  Rows with a null doc_id
    are counted but stand alone, with a null component_id, and are kept.  Repeated rows each get a row.  Other columns are ignored.
    A pair at the threshold is missed by all bands with probability 2e-5; candidates are confirmed on full sets.
    """
    small_batches(docs.sparkSession)
    sig = durable(signatures(docs), "signatures")
    worded = sig.where("n_shingles > 0 and doc_id is not null")
    with scope() as made:
        # Each distinct set has a number of its own (id), and is read from the text of its least document: a doc_id may stand in several rows with different texts.
        one = worded.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "t")).alias("from"))
        groups = durable(one.select("f1", "f2", "n_shingles", "from.doc_id", "from.t", F.monotonically_increasing_id().alias("id")), "sets")
        reps = worded.join(groups, ["doc_id", "t", "f1", "f2", "n_shingles"]).dropDuplicates(["id"])
        reps = durable(reps.select("id", "n_shingles", "f1", "f2", "bands", "sketch", "doc_id", "t"), "representatives")

        with scope() as spent:
            keys = reps.select("id", F.explode("bands").alias("key"))
            crowd = durable(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowd")
            blocks = _blocks(keys.join(crowd, "key"), "key", "n").select("block", "id").distinct()
            sketched = blocks.join(reps.select("id", "sketch"), "id").select("block", "id", "sketch")
            loose = durable(connected_components(_screened(_dealt(sketched))), "loose")
            if not crowd.where(F.col("n") > BLOCK).isEmpty():
                more = durable(_completion(reps, crowd, loose, percent), "completion")
                if not more.isEmpty():
                    known = loose.select(F.col("node").alias("a"), F.col("component").alias("b"))
                    loose = durable(connected_components(known.unionByName(more)), "loose")

        sized = loose.join(loose.groupBy("component").agg(F.count("*").alias("n")), "component")
        placed = durable(_blocks(sized.withColumnRenamed("node", "id"), "component", "n").select("component", "id", "block", "parts"), "blocks")
        release(docs.sparkSession, spent)
        print_of = reps.select("id", "f1", "f2", "doc_id", "t")
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))

        def with_text(rows: DataFrame) -> DataFrame:
            full = rows.join(print_of, "id").join(texts, ["doc_id", "t"])
            return _dealt(full.select("block", "id", "f1", "f2", "class", "minor", "text"))

        firm = placed.select("block", "id", F.lit(None).cast("long").alias("class"), F.lit(False).alias("minor"))
        firm = durable(_confirmed(with_text(firm), percent), "links")
        split = durable(placed.where("parts > 1"), "split")
        if split.isEmpty():
            final = firm.select(F.col("a").alias("node"), F.col("b").alias("component"))
        else:
            links = connected_components(firm)
            own = split.select("component", "id").distinct().join(links.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left")
            own = own.withColumn("class", F.coalesce("class", "id"))
            counts = own.groupBy("component", "class").agg(F.count("*").alias("n"))
            main = counts.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
            own = durable(own.join(main, "component").select("component", "id", "class", (F.col("class") != F.col("main")).alias("minor")), "classes")
            # Two exact ways for the minor rows: each meets every block of its component, or those rows that share a rarest shingle; by component, what is less.
            mass = own.groupBy("component").agg(F.count("*").alias("n"), F.count_if("minor").alias("m")).withColumn("sent", F.col("m") * F.ceil(F.col("n") / (BLOCK - ANCHORS)))
            mass = durable(mass.where(F.col("sent") > SPREAD * F.col("n")), "mass")
            few, met = None, []
            if not mass.isEmpty():
                many = own.join(mass.select("component"), "component", "left_semi").join(print_of, "id").join(texts, ["doc_id", "t"])
                with scope() as spent:
                    sets = durable(_sets(many.select("component", "id", "class", "minor", "f1", "f2", "text")), "shingles")
                with scope() as met:
                    keys = durable(_prefixes(sets, percent), "prefixes")
                release(docs.sparkSession, spent)
                few = mass.join(_meetings(keys), "component", "left").where(F.coalesce("met", F.lit(0)) <= F.col("sent") * LESS).select("component")
                few = durable(few, "few")
                own = own.join(few, "component", "left_anti")
            more = own.where("minor").join(split.select("component", "block").distinct(), "component").select("block", "id", "class", "minor")
            rest = split.join(own.select("id", "class"), "id").select("block", "id", "class", F.lit(False).alias("minor"))
            found = durable(_confirmed(with_text(rest.unionByName(more)), percent), "links")
            if few is not None and not few.isEmpty():
                pairs = durable(_probed(keys.join(few, "component", "left_semi"), percent), "pairs")
                sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
                pairs = pairs.join(sized, "a").withColumn("block", F.xxhash64(F.lit(11), "a", F.pmod(F.xxhash64(F.lit(12), "b"), F.col("chunks"))))
                asked = pairs.select("block", F.col("a").alias("id"), F.col("ca").alias("class"), F.lit(True).alias("minor")).distinct()
                asked = asked.unionByName(pairs.select("block", F.col("b").alias("id"), F.col("cb").alias("class"), F.lit(False).alias("minor")))
                found = found.unionByName(durable(_confirmed(with_text(asked), percent), "links"))
            release(docs.sparkSession, met)
            final = connected_components(firm.unionByName(found))
        final = final.withColumnRenamed("node", "id").groupBy("id").agg(F.min("component").alias("component"))
        whole = groups.join(final, "id", "left").select("f1", "f2", F.col("n_shingles").alias("size"), "doc_id", F.coalesce("component", "id").alias("component"))
        whole = _by_document(worded, whole)
    whole = durable(whole, "components")
    release(docs.sparkSession, made)
    same = (sig.f1 == whole.f1) & (sig.f2 == whole.f2) & (sig.n_shingles == whole["size"])
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(whole.select("f1", "f2", "size", "component"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _by_document(sets: DataFrame, whole: DataFrame) -> DataFrame:
    """whole (f1, f2, size, doc_id: the set's least, component) with the least doc_id reachable as component, also through documents that have several sets."""
    many = sets.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("many"))
    several = sets.join(many, F.col("doc_id") == F.col("many"), "left_semi").select(F.col("doc_id").alias("d"), "f1", "f2", F.col("n_shingles").alias("size"))
    several = several.join(whole.select("f1", "f2", "size", "component"), ["f1", "f2", "size"]).select("d", "component").distinct()
    joined = several.join(several.groupBy("d").agg(F.min("component").alias("to")), "d").where("component <> to").select(F.col("component").alias("a"), F.col("to").alias("b"))
    joined = durable(joined, "joined")
    if not joined.isEmpty():
        more = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
        whole = whole.join(more, "component", "left").withColumn("component", F.coalesce("to", "component"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("least"))
    return whole.join(least, "component").select("f1", "f2", "size", F.col("least").alias("component"))
