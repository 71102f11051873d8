"""Words and hashes of many texts at once, in NumPy over the buffers of an Arrow batch.

Texts of a batch are handled in slices of about ``SLICE`` bytes, so that the working memory of a
task does not follow the batch. A single longer text is a slice of its own (about 80 bytes of
memory per byte of text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLES = [_splitmix(256, 11), _splitmix(256, 77)]
STEPS = [_splitmix(64, 5) | np.uint64(1), _splitmix(64, 6) | np.uint64(1)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(allowed) -> np.ndarray:
    """Which bytes belong to a word."""
    table = np.zeros(256, dtype=bool)
    table[list(allowed)] = True
    return table


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(n: int):
    """Powers of BASE and of its inverse, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


class Rolling:
    """Hashes of any byte ranges of one buffer, the same wherever the bytes stand."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        powers = _grown(len(buf) + 1)
        self.inverse = powers[1]
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(TABLES[which][buf] * powers[0][: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Texts:
    """Texts of one slice: ``buf`` holds their bytes, text i is ``buf[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.buf, self.offsets, self.first = buf, offsets, first

    def __len__(self):
        return len(self.offsets) - 1

    def words(self, letters: np.ndarray, lower: bool = True):
        """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
        buf = LOWER[self.buf] if lower else self.buf
        inside = letters[buf]
        before, after = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < len(buf)]
        before[edges] = False
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return buf, starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array, size: int = SLICE):
    """The texts of an Arrow column in slices; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j


def windows(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out += hashes[k:k + count] * STEPS[which][k]
    return mix(out)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


#: Words of ``[^\x20\x09-\x0D]+``.
NON_BLANK = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALPHANUMERIC = byte_class(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
