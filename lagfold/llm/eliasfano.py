"""Elias-Fano sequences and the n-gram trie of one shard, laid out for a memory map.

A trie level holds the nodes of one n-gram length, sorted by (parent, word).  Their
context-relative keys, parent times vocabulary plus word, rise strictly and are stored as
an Elias-Fano sequence; a second one holds the monotone pointers, from each parent to its
first child.  A node is found by a successor search within its parent's range.  Smoothed
probabilities and back-off weights are single bytes into a codebook of each level.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U = np.uint64
_EACH, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: position of the k-th set bit of a byte: a table built by rule
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> "EliasFano":
        values = values.astype(U)
        n = len(values)
        l = max(0, (int(universe) // max(n, 1)).bit_length() - 1)  # noqa: E741
        low = np.zeros(n * l // 64 + 2, U)
        if l and n:
            part = values & U((1 << l) - 1)
            bit = np.arange(n, dtype=np.int64) * l
            word, shift, over = bit >> 6, (bit & 63).astype(U), (bit & 63) + l > 64
            for own, bits in ((word, part << shift), (word[over] + 1, part[over] >> (U(64) - shift[over]))):
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
                low[own[new]] |= np.bitwise_or.reduceat(bits, new) if len(new) else bits
        place = (values >> U(l)).astype(np.int64) + np.arange(n)
        length = (int(universe) >> l) + n + 2
        bits = np.zeros((length + 63) // 64 * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        count = _POP[high.view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64)
        return EliasFano(n, l, low, high, np.concatenate([[0], np.cumsum(count)]))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], np.int64), self.low, self.high, self.ones]

    @staticmethod
    def of(parts: list[np.ndarray]) -> "EliasFano":
        return EliasFano(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _select(self, directory: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero): the word by the directory, within it by sums of its bytes side by side."""
        word = np.searchsorted(directory, k, "right") - 1
        left = (k - directory[word]).astype(U)
        x = self.high[word]
        x = ~x if flip else x
        s = x - ((x >> U(1)) & U(0x5555555555555555))
        s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
        s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte i: set bits of bytes 0 to i
        place = (((((left * _EACH | _TOPS) - s) & _TOPS) >> U(7)) * _EACH >> U(56)) << U(3)
        left -= (s << U(8)) >> place & U(0xFF)
        return word * 64 + place.astype(np.int64) + _SELECT[(x >> place & U(0xFF)).astype(np.int64), left.astype(np.int64)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        bit = i * self.l
        word, shift = bit >> 6, (bit & 63).astype(U)
        x = self.low[word] >> shift
        over = (bit & 63) + self.l > 64
        x[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return x & U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.int64)
        return (((self._select(self.ones, i, False) - i).astype(U) << U(self.l)) | self.lows(i)).astype(np.int64)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1; the search for its successor stays within [begin, end)."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        x = x.astype(U)
        top = (x >> U(self.l)).astype(np.int64)
        at = np.where(top > 0, self._select(self.zeros, np.maximum(top - 1, 0), True) - np.maximum(top - 1, 0), 0)
        stop = self._select(self.zeros, top, True) - top
        if begin is not None:
            at, stop = np.maximum(at, begin), np.minimum(stop, end)
        want = x & U((1 << self.l) - 1)
        stop, at = np.maximum(stop, at), at.copy()
        last = stop.copy()
        live = np.flatnonzero(at < stop)
        while len(live):  # all successor searches halve their ranges together
            mid = (at[live] + stop[live]) >> 1
            less = self.lows(mid) < want[live]
            at[live[less]] = mid[less] + 1
            stop[live[~less]] = mid[~less]
            live = live[at[live] < stop[live]]
        out = np.full(len(x), -1)
        some = np.flatnonzero(at < last)
        some = some[self.lows(at[some]) == want[some]]
        out[some] = at[some]
        return out


ABSENT = 255


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): 255 bins of equal mass at most, each by its mean; exact for few values."""
    own, count = np.unique(values, return_counts=True)
    if len(own) > ABSENT:
        cut = np.minimum((np.cumsum(count) - count) * ABSENT // max(1, count.sum()), ABSENT - 1)
        size = np.bincount(cut, count, ABSENT)
        book = np.bincount(cut, own * count, ABSENT) / np.maximum(size, 1)
        return cut[np.searchsorted(own, values)].astype(np.uint8), book
    return np.searchsorted(own, values).astype(np.uint8), own


class Trie:
    """Levels from length 2 on; the first words are a sorted Elias-Fano sequence of their hashes."""

    def __init__(self, arrays: list[np.ndarray]):
        it = iter(arrays)
        ef = lambda: EliasFano.of([next(it) for _ in range(4)])
        self.words, self.counts = ef(), next(it)
        self.vocab = ef()
        self.size = int(next(it)[0])
        self.levels = []
        self.backoff = [(next(it), next(it))]
        while (keys := next(it, None)) is not None:
            self.levels.append((EliasFano.of([keys, next(it), next(it), next(it)]), ef(), next(it), next(it)))
            self.backoff.append((next(it), next(it)))

    @staticmethod
    def arrays(words: np.ndarray, counts: np.ndarray, vocab: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float) -> list[np.ndarray]:
        """``words``: sorted 63-bit hashes with ``counts`` as contexts; each level: (parent, word rank in ``vocab``, count), sorted."""
        out = [*EliasFano.build(words, 1 << 63).parts(), counts.astype(np.uint32), *EliasFano.build(vocab, 1 << 40).parts(), np.array([len(vocab)])]
        parents = None
        for parent, rank, c in [*levels, (np.zeros(0, np.int64),) * 3]:
            # every training occurrence of a word but the end is followed, here or in another shard
            mass, kinds = (np.asarray(counts, float) if parents is None else np.bincount(parent, c, parents)), np.bincount(parent, minlength=parents or len(words))
            parents = len(mass)
            code = np.full(parents, ABSENT, np.uint8)
            some = (mass > 0) & (kinds > 0)
            code[some], book = quantise(np.log10(discount * kinds[some] / mass[some]))
            out += [code, book]
            if not len(parent):
                break
            probability, pbook = quantise(np.log10((c - discount) / mass[parent]))
            first = np.searchsorted(parent, np.arange(parents + 1))
            out += [*EliasFano.build(parent.astype(U) * U(len(vocab)) + rank.astype(U), parents * len(vocab)).parts(), *EliasFano.build(first, len(parent) + 1).parts(), probability, pbook]
            parents = len(parent)
        return out

    def child(self, k: int, parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Nodes of level ``k`` (0: pairs) under the given parents, or -1; context-relative successor search."""
        out = np.full(len(parent), -1)
        if k < len(self.levels):
            keys, pointers, _, _ = self.levels[k]
            ok = np.flatnonzero((parent >= 0) & (rank >= 0))
            p = parent[ok]
            out[ok] = keys.find(p.astype(U) * U(self.size) + rank[ok].astype(U), pointers.access(p), pointers.access(p + 1))
        return out


class MappedTrie(Trie):
    """A trie written to an unlinked temporary file and mapped: its pages are the file cache's, not the worker's."""

    def __init__(self, arrays: list[np.ndarray]):
        self._file = tempfile.TemporaryFile()
        places = []
        for a in arrays:
            pad = -self._file.tell() % 8
            self._file.write(b"\0" * pad)
            places.append((self._file.tell(), a.dtype, len(a)))
            self._file.write(np.ascontiguousarray(a).tobytes())
        self._file.write(b"\0" * 8)
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        super().__init__([np.frombuffer(self._map, d, n, at) for at, d, n in places])
