"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.  Texts are
handled whole; work is cut into pieces of CHUNK bytes at word ends, so memory does not follow a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(11, 256)[_LOWER]
_BYTE[_SPACE] = 0
_POW = _odd(12, 1 << 12)
_ORDER = _odd(13, 16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, cut: np.ndarray, size: int = CHUNK):
    """Ranges of about `size` bytes that end where cut (a mask of allowed last bytes) holds, or at the end."""
    a = 0
    while a < len(data):
        b = min(len(data), a + size)
        while b < len(data):
            ends = np.flatnonzero(cut[a:b])
            if len(ends):
                b = a + int(ends[-1]) + 1
                break
            b = min(len(data), b + size)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, hashes): words per text, and a 64-bit hash of every word in order."""
    cut = _SPACE[data]
    cut[offsets[1:-1][offsets[1:-1] > 0] - 1] = True
    begins = np.zeros(len(data), bool)
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at, hashes = [], []
    for a, b in pieces(data, cut):
        d = data[a:b]
        word = ~_SPACE[d]
        start = word.copy()
        start[1:] &= ~word[:-1] | begins[a + 1 : b]
        s = np.flatnonzero(start)
        if not len(s):
            continue
        d = d[s[0] :]
        place = np.arange(len(d)) - np.repeat(s - s[0], np.diff(np.append(s, b - a)))
        h = _BYTE[d] * _POW[place & 4095]
        h += (place >> 12).astype(np.uint64) * _BYTE[d]
        hashes.append(mix(np.add.reduceat(h, s - s[0])))
        at.append(s + a)
    if not at:
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint64)
    return np.diff(np.searchsorted(np.concatenate(at), offsets)), np.concatenate(hashes)


def shingle_sets(column: pa.Array, k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles; fewer words: the whole sequence as one."""
    counts, words = word_hashes(*utf8(column))
    if len(words) >= k:
        whole = words[: len(words) - k + 1] * _ORDER[0]
        for j in range(1, k):
            whole += words[j : len(words) - k + 1 + j] * _ORDER[j]
        whole = mix(whole)
    a = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(whole[a : a + n - k + 1])
        elif n:
            yield mix((words[a : a + n] * _ORDER[:n]).sum(keepdims=True, dtype=np.uint64) + _ORDER[k + n])
        else:
            yield np.zeros(0, np.uint64)
        a += n
