"""Vectorised text primitives over Arrow string columns.

Words are maximal runs of bytes outside space and ``\\x09-\\x0D``; ASCII letters
count as lower case.  Every helper works on the raw UTF-8 buffer of a batch, so no
Python object is made per word.  A word's hash mixes its lower-cased bytes eight at a
time (a bijection for words of up to eight bytes), so that equal hashes of different words
are left to chance: n different words have one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond so many bytes are hashed one by one.
_LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null values are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a batch: byte ``starts`` and ``ends``, and ``of`` (word offsets by text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._aligned = data, offsets, None
        white = WHITE[data]
        inside = ~white
        first, last = inside.copy(), inside.copy()
        first[1:] &= white[:-1]
        last[:-1] &= white[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.starts, offsets)

    @classmethod
    def laid(cls, data: np.ndarray, offsets: np.ndarray) -> "Words":
        """The words that the offsets cut ``data`` into, whatever their bytes."""
        self = cls.__new__(cls)
        self.data, self.offsets, self._aligned = data, offsets, None
        self.starts, self.ends, self.of = offsets[:-1], offsets[1:], np.arange(len(offsets))
        return self

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def lanes(self, rows: np.ndarray, at: int) -> np.ndarray:
        """The lower-cased bytes ``at`` to ``at + 8`` of the given words as integers, zero beyond their ends."""
        if self._aligned is None:
            low = np.zeros((len(self.data) + 23) // 8 * 8, np.uint8)
            np.take(LOWER, self.data, out=low[: len(self.data)])
            self._aligned = low.view("<u8")
        begin = self.starts[rows] + at
        word, shift = begin >> 3, (begin & 7).astype(np.uint64) << np.uint64(3)
        x = self._aligned[word] >> shift
        # a shift by 64 isn't defined, so the next word is shifted twice
        x |= self._aligned[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return x & _BYTES[np.minimum(self.ends[rows] - begin, 8)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for words that differ only in the case of ASCII letters."""
        size = self.ends - self.starts
        out = mix64(self.lanes(np.arange(len(size)), 0) ^ mix64(size.astype(np.uint64)))
        more, at = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while len(more):
            out[more] = mix64(out[more] * np.uint64(0x9E3779B97F4A7C15) + self.lanes(more, at))
            at += 8
            more = more[size[more] > at]
        for k in np.flatnonzero(size > _LONG_WORD):
            out[k] = xxhash.xxh3_64_intdigest(LOWER[self.data[self.starts[k] : self.ends[k]]].tobytes())
        return out

    def equal(self, rows: np.ndarray, other: "Words", of: np.ndarray) -> np.ndarray:
        """Whether the words ``rows`` have the lower-cased bytes of the words ``of`` of ``other``."""
        size = self.ends[rows] - self.starts[rows]
        same = size == other.ends[of] - other.starts[of]
        more, at = np.flatnonzero(same), 0
        while len(more):
            ok = self.lanes(rows[more], at) == other.lanes(of[more], at)
            same[more[~ok]] = False
            at += 8
            more = more[ok & (size[more] > at)]
            if at >= _LONG_WORD:
                for k in more:
                    a, b = rows[k], of[k]
                    same[k] = bool((LOWER[self.data[self.starts[a] : self.ends[a]]] == LOWER[other.data[other.starts[b] : other.ends[b]]]).all())
                break
        return same


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words from each start; the caller drops starts that cross a text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + n]
    return mix64(out)


def shingles(h: np.ndarray, of: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each shingle; a text of 1 to ``size - 1`` words is one shingle."""
    count = np.diff(of)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    text = np.repeat(np.arange(len(count)), number)
    out = np.zeros(len(text), np.uint64)
    begin = np.repeat(of[:-1], number) + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    full = np.repeat(count >= size, number)
    all_of = rolling(h, size)
    out[full] = all_of[begin[full]]
    for k in np.flatnonzero((count > 0) & (count < size)):
        x = 0
        for v in h[of[k] : of[k + 1]]:
            x = (x * 0xD6E8FEB86659FD93 + int(v)) & 0xFFFFFFFFFFFFFFFF
        out[np.searchsorted(text, k)] = mix64(np.array([x + int(count[k])], np.uint64))[0]
    return out, text


def _steady() -> None:
    """Have the C library give arrays of 4 MB and more back as soon as they are freed; else it holds on to ever larger ones."""
    import ctypes

    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_steady()


def tidy() -> None:
    """Give what a task has freed back to the system; Python workers live on for the next task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_rest(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus`` (a native expression)."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
