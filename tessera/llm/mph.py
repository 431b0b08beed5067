"""Minimal perfect hashing of 128-bit keys, in numpy.

Keys are thrown into a bitmap of GAMMA bits a key; a key that stands alone in its bit is placed there, the others go on to the
next, smaller bitmap.  A key's number is the rank of its bit in all bitmaps together, so n keys get the numbers 0 to n - 1.  The number of
bitmaps follows log n, and a lookup reads 1.6 of them on average, however many keys there are.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.textual import mix

GAMMA = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _keyed(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h1 + mix(h2 ^ np.uint64(seed)))


def _bit(key: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(key + np.uint64(level + 1) * _STEP) % np.uint64(bits)).astype(np.int64)


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """32 bits that tell a key from those that are not in the index."""
    return (mix(h2 + mix(h1 ^ _STEP)) >> np.uint64(32)).astype(np.uint32)


class MinimalHash:
    """Numbers 0 to n - 1 for n distinct keys (h1, h2)."""

    def __init__(self, seed: int, sizes: np.ndarray, words: np.ndarray):
        self.seed, self.sizes, self.words = seed, sizes, words
        self.begin = np.append(0, np.cumsum(sizes))
        self.before = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalHash:
        """Two keys that one seed makes equal are told apart by the next; keys must be distinct."""
        seed = 0
        while len(np.unique(rest := _keyed(h1, h2, seed))) < len(h1):
            seed += 1
            if seed > 64:
                raise ValueError("keys are not distinct")
        sizes, words = [], []
        while len(rest):
            bits = -(-int(GAMMA * len(rest)) // 64) * 64
            at = _bit(rest, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        return cls(seed, np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for a key that certainly is not there (another may get any number: compare its fingerprint)."""
        out = np.full(len(h1), -1, np.int64)
        todo, key = np.arange(len(h1)), _keyed(h1, h2, self.seed)
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.begin[level] + _bit(key[todo], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.before[at >> 6] + np.bitwise_count(low))[hit]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        return np.array([self.seed, len(self.sizes), *self.sizes.tolist()], "<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes, at: int = 0) -> tuple[MinimalHash, int]:
        """The hash that dump() wrote at this offset, and where it ends."""
        seed, levels = np.frombuffer(raw, "<i8", 2, at).tolist()
        sizes = np.frombuffer(raw, "<i8", levels, at + 16)
        n = int(sizes.sum()) // 64
        words = np.frombuffer(raw, "<u8", n, at + 16 + 8 * levels)
        return cls(seed, sizes, words), at + 16 + 8 * levels + 8 * n
