"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in them.

Files, all in one folder that driver and executors share:

* `ids-*.bin`, one for each shard: 8 bytes `TSRIDS1\\0`, the width of an id in bytes (2 where the vocabulary fits, else 4) and a zero as
  little-endian 32-bit numbers, then the ids of the shard's documents, little-endian, one after the other.  Shards hold ascending doc_ids (null last).
* `index-*.mph`, one for each bucket of keys: the keys' MinimalHash, then for the keys in the order of their numbers four arrays: 32-bit fingerprints,
  32-bit shards, 64-bit starts in the shard and 64-bit lengths, both in ids.
* `shards` and `index`: Parquet tables that name the files.  Spark commits them, so a file of a task that was lost and run again is named once.

A key is a doc_id and the number of the row among those of that doc_id (0 for the first).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.minhash import _grouped
from tessera.llm.mph import MinimalHash, fingerprint
from tessera.llm.packing import Encoder
from tessera.llm.store import batches, durable, remove, shared_dir, trim
from tessera.llm.textual import mix

MAGIC = b"TSRIDS1\0"
HEADER = 16
#: Keys of an index bucket at most, on average.
KEYS = 1 << 20
#: Ids of a stretch of a shard that one task reads.
STRETCH = 1 << 20
#: Bytes of ids that a task hands on at a time.
PIECE = 1 << 22
#: Characters that are looked up at a time: each takes some 50 bytes meanwhile.
LOOKED_UP = 1 << 20

#: Characters whose NFC form is themselves and whose lower case is one character; texts of others are the library's.
_PLAIN = re.compile("[\t\n\r !-~¡-¬®-įı-ɏ]*")
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)", re.I)
#: White space of _PLAIN texts: it stands in no token, so a text may be cut after it.
_SPACE = re.compile("[\t\n\r ]")


class WordEncoder(Encoder):
    """Ids of texts by a vocabulary of lower-case words with word ends: runs of letters, single numbers, runs of other visible characters."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint16)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        at = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        code = self.lower[np.frombuffer(joined.encode("utf-16-le"), np.uint16)]
        kind = self.kind[code]
        begins = np.zeros(len(code) + 1, bool)
        begins[at[:-1]] = True
        start = begins[:-1] | (kind == 1)
        start[1:] |= kind[1:] != kind[:-1]
        s = np.flatnonzero(start)
        size = np.diff(np.append(s, len(code)))
        seen = kind[s] != 2
        place = np.arange(len(code)) - np.repeat(s, size)
        with np.errstate(over="ignore"):
            h = (self.byte[code & 255] + (code >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.power[place & 4095]
            if size.max() > 4096:
                h += (place >> 12).astype(np.uint64) * (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            key = mix(np.add.reduceat(h, s) + size.astype(np.uint64))[seen]
        s, size = s[seen], size[seen]
        where = self._find(key)
        if (where < 0).any():
            if len(self.begin) > 1_000_000:
                self.forget()
                where[:] = -1
            fresh, i = np.unique(key[where < 0], return_index=True)
            i = np.flatnonzero(where < 0)[i]
            small = code.tobytes().decode("utf-16-le")
            self._learn(fresh, [small[a : a + k] for a, k in zip(s[i].tolist(), size[i].tolist(), strict=True)])
            where = self._find(key)
        length = self.length[where]
        total = np.append(0, np.cumsum(length))
        ids = self.ids[np.repeat(self.begin[where] - total[:-1], length) + np.arange(total[-1])]
        return np.split(ids, total[np.searchsorted(s, at[1:-1])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if _PLAIN.fullmatch(t) and not _CONTRACTION.search(t) and not self.added.search(t):
                if len(t) > LOOKED_UP:
                    out[i] = np.concatenate([self.plain([t[a:b]])[0] for a, b in self.cuts(t)])
                    continue
                group.append(i)
                size += len(t)
            else:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
            if size >= LOOKED_UP:
                self.fill(out, texts, group)
                group, size = [], 0
        self.fill(out, texts, group)
        return out

    def fill(self, out: list[np.ndarray | None], texts: list[str], group: list[int]) -> None:
        for i, ids in zip(group, self.plain([texts[i] for i in group]), strict=True):
            out[i] = ids

    @staticmethod
    def cuts(text: str) -> Iterator[tuple[int, int]]:
        """Stretches of a text, each cut after the first white space past LOOKED_UP characters; a run without any stays whole."""
        a = 0
        while a < len(text):
            space = _SPACE.search(text, a + LOOKED_UP)
            b = space.end() if space else len(text)
            yield a, b
            a = b


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker, kept between tasks that encode."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """For tasks of later stages: no text is encoded any more, and an encoder that has met a million words holds some 200 MB."""
    if _encoders:
        _encoders.clear()
        trim()


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder; Arrow knows file, hdfs, s3 and gs."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "doc_id", "nth"), F.xxhash64("nth", F.lit(2), "doc_id")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "doc_id", "nth"), F.lit(buckets)).cast("int").alias("bucket")


@dataclass
class TokenFiles:
    """Written token files: keys (doc_id, nth), shards (shard, file, before, n_docs, n_ids), index (bucket, file, n_keys)."""

    folder: str
    keys: DataFrame
    shards: DataFrame
    index: DataFrame
    buckets: int

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, nth, shard, start, n_tokens) of keys (doc_id, nth), by one read of the index each; keys that are not there are left out.  start: in the shard."""
        folder = self.folder

        def run(stream):
            drop_encoders()
            files, at = _files(folder)
            for t in _grouped(stream, 0):
                bucket = t.column("bucket").to_numpy()
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                for f, e in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                    part = t.slice(f, e - f)
                    with files.open_input_file(f"{at}/{part.column('file')[0].as_py()}") as x:
                        raw = x.read()
                    hashed, end = MinimalHash.load(raw)
                    n = int(np.bitwise_count(hashed.words).sum())
                    prints, shards = np.frombuffer(raw, "<u4", n, end), np.frombuffer(raw, "<u4", n, end + 4 * n)
                    starts, sizes = np.frombuffer(raw, "<i8", n, end + 8 * n), np.frombuffer(raw, "<i8", n, end + 16 * n)
                    h1, h2 = (part.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
                    place = hashed.find(h1, h2)
                    there = (place >= 0) & (prints[place] == fingerprint(h1, h2)) if n else np.zeros(len(h1), bool)
                    place, part = place[there], part.filter(pa.array(there))
                    columns = [part.column("doc_id").combine_chunks(), part.column("nth").combine_chunks(), pa.array(shards[place].astype(np.int32)), pa.array(starts[place]), pa.array(sizes[place])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nth", "shard", "start", "n_tokens"])

        h1, h2 = _hashes()
        asked = keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("long")).select(_bucket(self.buckets), "doc_id", "nth", h1.alias("h1"), h2.alias("h2"))
        asked = asked.join(self.index.select("bucket", "file"), "bucket").select("bucket", "file", "doc_id", "nth", "h1", "h2")
        asked = asked.repartition(self.buckets, "bucket").sortWithinPartitions("bucket")
        return asked.mapInArrow(run, "doc_id long, nth long, shard int, start long, n_tokens long")

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """(doc_id, nth, start, n_tokens, ids binary) of keys (default: all), read from the shards.

        start: ids of all documents before it, in all shards.  ids: little-endian unsigned 32-bit, the end id with them.
        """
        folder = self.folder

        def run(stream):
            drop_encoders()
            files, at = _files(folder)
            for t in _grouped(stream, 0):
                name = t.column("file").to_pylist()
                start, size = t.column("start").to_numpy(), t.column("n_tokens").to_numpy()
                done, held, x, opened, width = 0, 0, None, None, 4
                ids: list[bytes] = []
                for i in range(len(t)):
                    if opened != name[i]:
                        x = files.open_input_file(f"{at}/{name[i]}")
                        opened, head = name[i], x.read_at(HEADER, 0)
                        if head[:8] != MAGIC:
                            raise ValueError(f"{opened} holds no token ids")
                        width = int.from_bytes(head[8:12], "little")
                    raw = x.read_at(int(size[i]) * width, HEADER + int(start[i]) * width)
                    ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                    held += len(ids[-1])
                    if held > PIECE or i == len(t) - 1:
                        part = t.slice(done, len(ids)).combine_chunks()
                        yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("doc_id", "nth", "first", "n_tokens")), pa.array(ids, pa.binary())], names=["doc_id", "nth", "start", "n_tokens", "ids"])
                        done, held, ids = i + 1, 0, []

        found = self.locate(self.keys if keys is None else keys).join(self.shards.select("shard", "file", "before"), "shard")
        stretch = F.xxhash64("shard", F.floor(F.col("start") / STRETCH))
        found = found.select(stretch.alias("stretch"), "file", "doc_id", "nth", (F.col("before") + F.col("start")).alias("first"), "start", "n_tokens")
        found = found.repartition(max(self.buckets, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "stretch").sortWithinPartitions("stretch", "start")
        return found.mapInArrow(run, "doc_id long, nth long, start long, n_tokens long, ids binary")


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, shards: int | None = None) -> TokenFiles:
    """Write every row of docs (doc_id, text, ...) as token ids, in ascending doc_id order, and index it.

    A null text is empty: the end id alone.  Rows of equal doc_id stand in the order of a hash of their texts and are numbered; a null doc_id is a key
    like any other and stands last.  Very long texts are encoded whole.  Other columns are ignored.  An empty table gives no file.
    Each task of the scan encodes its texts into a run; only places in runs are sorted, and the shards are copied from the runs in that order: no text or id is shuffled.
    shards (default: the session's shuffle partitions) bounds the number of shards, which hold about equal shares of the rows; all are streamed.
    """
    spark: SparkSession = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    runs = f"{folder}/runs"
    files, at = _files(runs)
    files.create_dir(at, recursive=True)

    def coded(stream):
        """Ids of the rows of one task of the scan, in its order, as a run of its own."""
        enc = encoder(tokenizer)
        wide = 2 if max(enc.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else 4
        files, at = _files(runs)
        name, out, start = f"run-{uuid.uuid4().hex}", None, 0
        try:
            for batch in stream:
                out = out or files.open_output_stream(f"{at}/{name}")
                size = []
                for ids in enc.encode(["" if t is None else t for t in batch.column(1).to_pylist()]):
                    out.write(np.append(ids, end_id).astype(f"<u{wide}").tobytes())
                    size.append(len(ids) + 1)
                first = start + np.append(0, np.cumsum(size, dtype=np.int64))
                start = int(first[-1])
                columns = [batch.column(0), batch.column(2), pa.array([name] * len(size), pa.string()), pa.array(first[:-1]), pa.array(size, pa.int64()), pa.array(np.full(len(size), wide, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "run", "at", "n_tokens", "wide"])
        finally:
            if out is not None:
                out.close()

    def shard(stream):
        """Copies the sorted documents of one task from their runs to a shard; what stands together in a run is read at once."""
        drop_encoders()
        (source, there), (files, at) = _files(runs), _files(folder)
        number, name, out, start = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.bin", None, 0
        last, nth, opened, x = object(), 0, None, None
        try:
            for batch in stream:
                doc, run = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                place, size, wide = (batch.column(i).to_numpy() for i in (3, 4, 5))
                if out is None and doc:
                    out = files.open_output_stream(f"{at}/{name}")
                    out.write(MAGIC + int(wide[0]).to_bytes(4, "little") + bytes(4))
                i = 0
                while i < len(doc):
                    j, total = i + 1, int(size[i])
                    while j < len(doc) and run[j] == run[i] and place[j] == place[i] + total and total < STRETCH:
                        total += int(size[j])
                        j += 1
                    if opened != run[i]:
                        if x is not None:
                            x.close()
                        x, opened = source.open_input_file(f"{there}/{run[i]}"), run[i]
                    out.write(x.read_at(total * int(wide[i]), int(place[i]) * int(wide[i])))
                    i = j
                order = []
                for d in doc:
                    nth = nth + 1 if d == last else 0
                    last = d
                    order.append(nth)
                first = start + np.append(0, np.cumsum(size))
                start = int(first[-1])
                columns = [batch.column(0), pa.array(order, pa.int64()), pa.array(np.full(len(doc), number, np.int32)), pa.array([name] * len(doc), pa.string()), pa.array(first[:-1]), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nth", "shard", "file", "start", "n_tokens"])
        finally:
            for f in (x, out):
                if f is not None:
                    f.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches(spark, 256):
        found = durable(rows.select("doc_id", "text", F.xxhash64("text")).mapInArrow(coded, "doc_id long, t long, run string, at long, n_tokens long, wide int"), "runs")
    order = [F.col("doc_id").asc_nulls_last(), F.col("t"), F.col("run"), F.col("at")]
    found = found.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    places = durable(found.mapInArrow(shard, "doc_id long, nth long, shard int, file string, start long, n_tokens long"), "places")
    remove(spark, runs)
    # One row for each shard: a number that the caller sets.
    ends = (F.min_by("doc_id", "start").alias("first"), F.max_by(F.struct("doc_id", "nth"), "start").alias("last"))
    summed = places.groupBy("shard", "file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), *ends).orderBy("shard").collect()
    table, going, before, key, seen = [], [], 0, None, 0
    for r in summed:
        more = seen if table and r["first"] == key else 0
        if more:  # a doc_id that goes on from the shard before is numbered on
            going.append((r["shard"], key, more))
        key, seen = r["last"]["doc_id"], r["last"]["nth"] + 1 + (more if r["last"]["doc_id"] == r["first"] else 0)
        table.append((r["shard"], r["file"], before, r["n_docs"], r["n_ids"]))
        before += r["n_ids"]
    of = spark.createDataFrame(table, "shard int, file string, before long, n_docs long, n_ids long")
    of.coalesce(1).write.parquet(f"{folder}/shards")
    of = spark.read.schema(of.schema).parquet(f"{folder}/shards")
    keyed = places.select("doc_id", "nth", "shard", "start", "n_tokens")
    if going:
        on = F.broadcast(spark.createDataFrame(going, "s int, d long, more long"))  # a row for each shard at most
        keyed = keyed.join(on, (keyed.shard == on.s) & keyed.doc_id.eqNullSafe(on.d), "left")
        keyed = keyed.select("doc_id", (F.col("nth") + F.coalesce("more", F.lit(0))).alias("nth"), "shard", "start", "n_tokens")
    buckets = max(shards, -(-sum(r["n_docs"] for r in summed) // KEYS))

    def indexed(stream):
        drop_encoders()
        files, at = _files(folder)
        for t in _grouped(stream, 0):
            bucket = t.column("bucket").to_numpy()
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for f, e in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                part = t.slice(f, e - f)
                h1, h2 = (part.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
                hashed = MinimalHash.build(h1, h2)
                place = np.argsort(hashed.find(h1, h2))
                columns = [fingerprint(h1, h2), *(part.column(c).to_numpy() for c in ("shard", "start", "n_tokens"))]
                name = f"index-{uuid.uuid4().hex}.mph"
                with files.open_output_stream(f"{at}/{name}") as out:
                    out.write(hashed.dump())
                    for x, kind in zip(columns, ("<u4", "<u4", "<i8", "<i8"), strict=True):
                        out.write(x[place].astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[f : f + 1]), pa.array([name]), pa.array([e - f], pa.int64())], names=["bucket", "file", "n_keys"])

    h1, h2 = _hashes()
    dealt = keyed.select(_bucket(buckets), h1.alias("h1"), h2.alias("h2"), "shard", "start", "n_tokens").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    # One row for each bucket, like the shards: a table of one file, where a file for each task would hold a row or none.
    index = spark.createDataFrame(dealt.mapInArrow(indexed, "bucket int, file string, n_keys long").collect(), "bucket int, file string, n_keys long")
    index.coalesce(1).write.parquet(f"{folder}/index")
    index = spark.read.schema(index.schema).parquet(f"{folder}/index")
    return TokenFiles(folder, keyed.select("doc_id", "nth"), of, index, buckets)
