"""Packing by power-of-two decomposition: a document of n ids becomes one piece per binary digit of n.

Pieces longer than `longest` are cut into pieces of that length.  Every piece is a sequence of its own, so no
sequence crosses documents and, its length being a power of two, none is padded; sequences of equal length share a bucket.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import small_batches
from tessera.llm.textual import mix, utf8

LONGEST = 2048
#: Tokens whose ids a worker remembers; then it starts afresh.
REMEMBERED, TABLE_BITS = 1_000_000, 22
#: Bytes of text that are tokenised at a time.
PIECE = 1 << 20

#: Texts of these characters are split by the vectorised rule, which is the vocabulary's pattern on them; others by the library.
_PLAIN = re.compile("[\t\n\r !-~¡-¬®-±´-¸º»¿-ɏ]*")
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")


class Encoder:
    """Ids of texts by a byte-level vocabulary file, with a memory of tokens: distinct tokens are few."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        # Tokens that the vocabulary adds to its merges (like <|endoftext|>) are found in texts too: such texts are the library's.
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        rng = np.random.Generator(np.random.PCG64(5))
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.kind = np.zeros(0x250, np.uint8)  # 0 letter, 1 number, 2 white space, 3 other
        for c in range(0x250):
            s = chr(c)
            self.kind[c] = 0 if s.isalpha() else 1 if s.isnumeric() else 2 if s.isspace() else 3
        # The visible characters by which a byte-level vocabulary writes bytes: itself, or the next free one from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self.visible = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.forget()

    def forget(self) -> None:
        """An empty hash table of token keys (0: free), probed linearly, and no ids."""
        self.slots, self.entry = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.begin, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entries of keys; -1: not there."""
        out = np.full(len(key), -1, np.int64)
        todo, at = np.arange(len(key)), (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(todo):
            there = self.slots[at]
            hit = there == key[todo]
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _learn(self, keys: np.ndarray, tokens: list[str]) -> None:
        """Distinct new keys and their tokens, each of which the vocabulary's merges handle by itself."""
        new = [[t.id for t in self.tokenizer.model.tokenize(x.encode().decode("latin-1").translate(self.visible))] for x in tokens]
        length = np.fromiter(map(len, new), np.int64, len(new))
        entry = np.arange(len(self.begin), len(self.begin) + len(new), dtype=np.int32)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.ids = np.append(self.ids, np.array([i for x in new for i in x], np.int32))
        todo, at = np.arange(len(keys)), (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.entry[at[put]] = keys[todo[put]], entry[todo[put]]
            on = np.ones(len(todo), bool)
            on[put] = False
            todo, at = todo[on], (at[on] + 1) & ((1 << TABLE_BITS) - 1)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that consist of _PLAIN characters, without contractions."""
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.int32) for _ in texts]
        code = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        at = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
        kind, n = self.kind[code], len(code)
        head = np.zeros(n, bool)
        head[at[:-1][at[:-1] < n]] = True
        same = np.zeros(n, bool)
        same[1:] = kind[1:] == kind[:-1]
        start = ~same | head
        # Of a run of white space before other text the last character stands apart; a space joins what follows.
        space = kind == 2
        ends = np.zeros(n, bool)  # the last character of a run of white space that other text of the same document follows
        ends[:-1] = space[:-1] & ~space[1:] & ~head[1:]
        start |= ends
        joins = np.zeros(n, bool)
        joins[1:] = ends[:-1] & (code[:-1] == 32)
        start &= ~joins
        s = np.flatnonzero(start)
        size = np.diff(np.append(s, n))
        place = np.arange(n) - np.repeat(s, size)
        h = (self.byte[code & 255] + (code >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.power[place & 4095]
        if size.max() > 4096:
            h += (place >> 12).astype(np.uint64) * (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key = mix(np.add.reduceat(h, s) + size.astype(np.uint64))
        where = self._find(key)
        if (lost := where < 0).any():
            fresh, i = np.unique(key[lost], return_index=True)
            i = np.flatnonzero(lost)[i]
            if len(self.begin) + len(fresh) > REMEMBERED:
                self.forget()
                fresh, i = np.unique(key, return_index=True)
            self._learn(fresh, [joined[a : a + k] for a, k in zip(s[i].tolist(), size[i].tolist(), strict=True)])
            where[lost] = self._find(key[lost]) if len(self.begin) > len(fresh) else -1
            if (where < 0).any() or len(self.begin) == len(fresh):
                where = self._find(key)
        length = self.length[where]
        total = np.append(0, np.cumsum(length))
        ids = self.ids[np.repeat(self.begin[where] - total[:-1], length) + np.arange(total[-1])]
        return np.split(ids, total[np.searchsorted(s, at[1:-1])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        group: list[int] = []
        size = 0

        def flush():
            for i, ids in zip(group, self.plain([texts[i] for i in group]), strict=True):
                out[i] = ids

        for i, t in enumerate(texts):
            if _PLAIN.fullmatch(t) and not _CONTRACTION.search(t) and not self.added.search(t):
                group.append(i)
                size += len(t)
                if size >= PIECE:
                    flush()
                    group, size = [], 0
            else:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Pieces of n ids: as many of the longest as go in, then the binary digits of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids binary, bucket, sequence_id, offset): a row for each piece.

    ids: little-endian unsigned 32-bit ids of the piece.  A null text is empty: its only piece is the end id.
    sequence_id: unique; those of a length are one range, so that a reader can batch equal lengths.  Repeated rows are packed each; a null doc_id stays null.
    longest must be a power of two.  Other columns are ignored.  No shuffle.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            doc, start, length, total, ids = [], [], [], [], []

            def made():
                names = ["doc_id", "start", "length", "doc_tokens", "ids"]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([doc, start, length, total, ids], types, strict=True)], names=names)

            size = 0
            for i, found in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                raw = np.append(found, end_id).astype("<u4").tobytes()
                at = 0
                for k in lengths(len(raw) // 4, longest):
                    doc.append(i)
                    start.append(at)
                    length.append(k)
                    total.append(len(raw) // 4)
                    ids.append(raw[4 * at : 4 * (at + k)])
                    at += k
                size += len(raw)
                if size > 1 << 24:
                    yield made()
                    doc, start, length, total, ids, size = [], [], [], [], [], 0
            yield made()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")
    bucket = F.round(F.log2("length")).cast("int")
    unique = F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id()
    return pieces.select("*", bucket.alias("bucket"), unique.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
