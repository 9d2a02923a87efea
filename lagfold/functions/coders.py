"""Range coders for symbol sequences: serial by nature, so one call codes one run or block."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np

TOTAL = 1 << 16
_TOP, _HALF, _QUARTER = 1 << 32, 1 << 31, 1 << 30


def frequencies(p: np.ndarray, total: int = TOTAL) -> np.ndarray:
    """Cumulative integer frequencies that sum to ``total``, each symbol at least 1."""
    n = len(p)
    if n > total:
        raise ValueError(f"{n} symbols don't fit {total} frequencies")
    p = np.maximum(np.nan_to_num(np.asarray(p, float)), 0)
    p = p / p.sum() if p.sum() > 0 else np.full(n, 1 / n)
    f = np.maximum(np.floor(p * total).astype(np.int64), 1)
    gap = total - int(f.sum())
    if gap > 0:
        f[np.argmax(f)] += gap
    for k in np.argsort(-f, kind="stable"):  # the largest give back what the floor of 1 has taken
        if gap >= 0:
            break
        back = min(-gap, int(f[k]) - 1)
        f[k] -= back
        gap += back
    return np.concatenate([[0], np.cumsum(f)])


def _settled(low: int, high: int) -> int:
    """Leading bits that both bounds share."""
    return 32 - (low ^ high).bit_length()


def _near(low: int, high: int) -> int:
    """How often bounds with different first bits close in on the middle: the bits after the first that are 1 below and 0 above."""
    return 31 - (~(low & ~high) & _HALF - 1).bit_length()


class Encoder:
    """Binary arithmetic coding with 32-bit bounds and delayed bits; bits that are settled leave at once."""

    def __init__(self):
        self.low, self.high, self.waiting, self.bits = 0, _TOP - 1, 0, []

    def push(self, begin: int, end: int, total: int = TOTAL):
        width = self.high - self.low + 1
        high = self.low + width * end // total - 1
        low = self.low + width * begin // total
        if n := _settled(low, high):
            put = f"{low >> (32 - n):0{n}b}"
            if self.waiting:
                put = put[0] + ("1" if put[0] == "0" else "0") * self.waiting + put[1:]
                self.waiting = 0
            self.bits.append(put)
            low, high = low << n & _TOP - 1, high << n & _TOP - 1 | (1 << n) - 1
        if n := _near(low, high):
            self.waiting += n
            low, high = (low << n) - (_HALF << n) + _HALF, (high << n) - (_HALF << n) + _HALF + (1 << n) - 1
        self.low, self.high = low, high

    def finish(self) -> bytes:
        self.bits.append("0" + "1" * (self.waiting + 1) if self.low < _QUARTER else "1" + "0" * (self.waiting + 1))
        self.waiting = 0
        return np.packbits(np.frombuffer("".join(self.bits).encode(), np.uint8) & 1).tobytes()


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.high = data, 0, 0, _TOP - 1
        self.code = self._bits(32)

    def _bits(self, n: int) -> int:
        """The next ``n`` bits, at most 32; zeros after the end."""
        byte, skip = divmod(self.at, 8)
        self.at += n
        return int.from_bytes(self.data[byte : byte + 8].ljust(8, b"\0"), "big") >> (64 - skip - n) & (1 << n) - 1

    def pull(self, cum, total: int = TOTAL) -> int:
        """A symbol by its cumulative frequencies; a list of them is searched faster than an array."""
        width = self.high - self.low + 1
        value = ((self.code - self.low + 1) * total - 1) // width
        s = bisect_right(cum, value) - 1
        self._narrow(int(cum[s]), int(cum[s + 1]), total)
        return s

    def pull_by(self, below, levels: int, total: int) -> int:
        """A symbol whose cumulative frequencies are a function, found by halving."""
        width = self.high - self.low + 1
        value = ((self.code - self.low + 1) * total - 1) // width
        lo, hi = 0, levels
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if below(mid) <= value else (lo, mid)
        self._narrow(below(lo), below(lo + 1), total)
        return lo

    def _narrow(self, begin: int, end: int, total: int):
        width = self.high - self.low + 1
        high = self.low + width * end // total - 1
        low, code = self.low + width * begin // total, self.code
        if n := _settled(low, high):
            low, high, code = low << n & _TOP - 1, high << n & _TOP - 1 | (1 << n) - 1, code << n & _TOP - 1 | self._bits(n)
        if n := _near(low, high):
            off = (_HALF << n) - _HALF
            low, high, code = (low << n) - off, (high << n) - off + (1 << n) - 1, (code << n) - off + self._bits(n)
        self.low, self.high, self.code = low, high, code


#: Frequencies of conditional tables add up to this.
FINE = 1 << 24


def normal_below(levels: int, zmax: float, mean: float, std: float, total: int = FINE):
    """Cumulative frequencies of equal bins on [-zmax, zmax] under a normal law, as a function of the bin: every bin has 1 at least, the outer ones the tails."""
    width, scale = 2 * zmax / levels, 1 / (max(std, 1e-6) * math.sqrt(2))

    def below(k: int) -> int:
        if k <= 0 or k >= levels:
            return 0 if k <= 0 else total
        return k + int(0.5 * (1 + math.erf((k * width - zmax - mean) * scale)) * (total - levels))

    return below


def encode_iid(symbols, cum: np.ndarray) -> bytes:
    e = Encoder()
    for s in symbols:
        e.push(int(cum[s]), int(cum[s + 1]))
    return e.finish()


def decode_iid(data: bytes, n: int, cum: np.ndarray) -> list[int]:
    d, cum = Decoder(data), np.asarray(cum).tolist()
    return [d.pull(cum) for _ in range(n)]


def encode_markov(states, t: np.ndarray, pi: np.ndarray) -> bytes:
    """The first state by pi, each later one by the row of its predecessor."""
    tables: dict[int, np.ndarray] = {}
    e, cum = Encoder(), frequencies(pi)
    for s in states:
        e.push(int(cum[s]), int(cum[s + 1]))
        if s not in tables:
            tables[s] = frequencies(t[s])
        cum = tables[s]
    return e.finish()


def decode_markov(data: bytes, n: int, t: np.ndarray, pi: np.ndarray) -> list[int]:
    d, out, tables = Decoder(data), [], {}
    for k in range(n):
        if k == 0:
            cum = frequencies(pi)
        else:
            if out[-1] not in tables:
                tables[out[-1]] = frequencies(t[out[-1]]).tolist()
            cum = tables[out[-1]]
        out.append(d.pull(cum))
    return out


def gaussian_table(levels: int, zmax: float, mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    """Cumulative frequencies of equal bins on [-zmax, zmax] under a normal law; the outer bins take the tails' floor."""
    edges = np.linspace(-zmax, zmax, levels + 1)
    cdf = np.array([0.5 * (1 + math.erf((x - mean) / (max(std, 1e-6) * math.sqrt(2)))) for x in edges])
    return frequencies(np.maximum(np.diff(cdf), 1e-12))
