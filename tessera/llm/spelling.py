"""Spelling variants without pairs: words meet in groups of (position, prefix, suffix), and deletions join the vocabulary.

Words get numbers that rise from the most frequent to the least (ties: code-point order), so that the least number in a group is its most frequent
word.  A word of n code points stands in n groups, one for each position that a replacement may change; such a group's words differ in
that code point alone, so it holds no more words than there are letters, and needs only its size and its two least numbers.  The distinct
deletions of a word stand under the same kind of key as the words themselves, so one that is a word meets it there.  Each word sums up what its groups told; no pair is ever a row.

Keys are 128 bits: the exclusive or, over the code points, of a hash of the code point and its place.  Taking one out, or moving those behind it,
takes constant time, so a word of n code points costs n rows of fixed size, however long it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import batches, durable
from tessera.llm.textual import mix

LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]+")
_END = re.compile(f"[^{LETTERS}]")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Characters of a text that are cut into words at a time, and distinct words that a task sums before it hands them on.
PIECE, HELD = 1 << 20, 1 << 18
#: Code points of a word at least, and its occurrences; how often a form occurs for each occurrence of the word.
LEAST, SEEN, RATIO = 5, 3, 2
_SALT = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
#: Keys of groups that a task makes at a time.
KEYS = 1 << 18


def _runs(text: str) -> Counter:
    """How often each maximal run of letters occurs; the text is cut at other characters, so memory follows its distinct runs."""
    if len(text) <= PIECE:
        return Counter(_RUN.findall(text))
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = _END.search(text, min(at + PIECE, len(text)))
        to = end.start() if end else len(text)
        out.update(_RUN.findall(text[at:to]))
        at = to + 1
    return out


def words(docs: DataFrame, slips: int | None = 97) -> DataFrame:
    """(word, n): runs of letters of the texts of docs (doc_id, text, ...), A-Z lower-cased, and how often they occur.

    Where `slips` divides h, the unsigned crc32 of "<doc_id>:<run>", the run loses its code point h % length; None: nowhere.  Null texts, and those without letters, have
    no words; a null doc_id is written as an empty one.  Repeated rows count each.  Empty results of a slip are no words.  Other columns are ignored.
    """

    def run(stream):
        held: dict[str, int] = {}

        def made():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in stream:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in _runs(text).items():
                    small = word.lower() if word.isascii() else word.translate(_LOWER)
                    if slips:
                        h = zlib.crc32(small.encode(), begun)
                        if h % slips == 0:
                            h %= len(small)
                            small = small[:h] + small[h + 1 :]
                    held[small] = held.get(small, 0) + n
                if len(held) > HELD:
                    yield made()
        yield made()

    with batches(docs.sparkSession, 512):
        parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
        return durable(parts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _hashed(code: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(code.astype(np.uint64) + _SALT[lane]) + place.astype(np.uint64) * _SALT[1 - lane])


def _before(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The exclusive or of what stands before each element in its own stretch."""
    total = np.append(np.uint64(0), np.bitwise_xor.accumulate(x))
    return total[:-1] ^ np.repeat(total[first], size)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, kind, key, key) of every group: kind 0 the word itself, 1 one of its distinct deletions, 2 a replaced position."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(first, size)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (place[1:] > 0)  # taking out either of two equal neighbours gives the same word
    own, gone, wild = [], [], []
    with np.errstate(over="ignore"):
        for lane in (0, 1):
            here, back = _hashed(code, place, lane), _hashed(code, place - 1, lane)
            whole = np.bitwise_xor.reduceat(here, first) if len(code) else here
            behind = np.bitwise_xor.reduceat(back, first) if len(code) else back
            length = mix(size.astype(np.uint64) + _SALT[lane])
            own.append(mix(whole + length))
            shifted = _before(here, first, size) ^ np.repeat(behind, size) ^ _before(back, first, size) ^ back
            gone.append(mix(shifted + np.repeat(mix(size.astype(np.uint64) - np.uint64(1) + _SALT[lane]), size)))
            wild.append(mix((np.repeat(whole, size) ^ here) + np.repeat(length, size) * np.uint64(3) + mix(place.astype(np.uint64) + _SALT[1 - lane])))
    kind = np.concatenate([np.zeros(len(words), np.int8), np.ones(int((~again).sum()), np.int8), np.full(len(code), 2, np.int8)])
    k1, k2 = (np.concatenate([own[i], gone[i][~again], wild[i]]) for i in (0, 1))
    return np.concatenate([np.arange(len(words)), of[~again], of]), kind, k1, k2


def _told(kind: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, near words, least id among them) as each group tells its members; rows sorted by key, then kind, then id."""
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | ((kind[1:] == 2) != (kind[:-1] == 2)))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k1)))
    at = np.repeat(first, size)
    n = np.repeat(size, size)
    wild = (kind == 2) & (n > 1)
    second = ids[np.minimum(at + 1, len(ids) - 1)]
    out = [(ids[wild], n[wild] - 1, np.where(ids == ids[at], second, ids[at])[wild])]
    met = (kind[at] == 0) & (n > 1)
    lead = met & (kind == 0)
    out.append((ids[lead], n[lead] - 1, second[lead]))
    shorter = met & (kind == 1)
    out.append((ids[shorter], np.ones(int(shorter.sum()), np.int64), ids[at][shorter]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def variants(counts: DataFrame, least: int = LEAST, seen: int = SEEN, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of counts (word, n, ...; distinct) of `least` code points and `seen` occurrences.

    Near words differ by exactly one inserted, deleted or replaced code point.  form: the near word of largest n (ties: first in code-point order) if
    it occurs at least `ratio` times as often, else null; root: the last word that forms lead to.  Null words are left out; an empty table gives no rows.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("n").desc(), F.col("word").asc()]
    ranked = counts.where((F.char_length("word") >= least) & (F.col("n") >= seen)).select("word", F.col("n").cast("long"))
    ranked = durable(ranked.repartitionByRange(n, *order).sortWithinPartitions(*order).select("word", "n", F.monotonically_increasing_id().alias("id")), "vocabulary")

    def grouped(stream):
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (total == 0 or total < KEYS):
                    total += len(texts[to])
                    to += 1
                of, kind, k1, k2 = keys(texts[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(kind), pa.array(ids[at:to][of])], names=["k1", "k2", "kind", "id"])
                at = to

    def told(stream):
        """Rows come sorted; a group that the end of a batch cuts waits for the rest."""
        rest = None
        for batch in stream:
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            k1, k2, kind, ids = (whole.column(i).to_numpy() for i in range(4))
            last = np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1])) if len(k1) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = whole.slice(cut).to_batches()[0] if cut < len(whole) else None
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _told(kind[:cut], k1[:cut], k2[:cut], ids[:cut])], names=["id", "near", "best"])
        if rest is not None:
            k1, k2, kind, ids = (rest.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _told(kind, k1, k2, ids)], names=["id", "near", "best"])

    rows = ranked.select("id", "word").mapInArrow(grouped, "k1 long, k2 long, kind byte, id long")
    rows = rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "kind", "id")
    near = rows.mapInArrow(told, "id long, near long, best long").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = ranked.select(F.col("id").alias("best"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    joined = ranked.join(near, "id", "left").join(best, "best", "left")
    takes = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    found = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("near_word")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n"), F.when(takes, F.col("best")).alias("to"))
    found = durable(found, "forms")

    # A form occurs at least `ratio` times as often, so chains are short; each round doubles what a pointer spans.
    leads = durable(found.where("to is not null").select("id", "to"), "leads")
    while True:
        further = leads.select(F.col("id").alias("mid"), F.col("to").alias("beyond"))
        step = durable(leads.join(further, leads["to"] == further["mid"], "left").select("id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "leads")
        leads = step.select("id", "to")
        if step.where("moved").isEmpty():
            break
    ends = leads.select("id", F.col("to").alias("end")).join(ranked.select(F.col("id").alias("end"), F.col("word").alias("root")), "end").select("id", "root")
    return found.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
