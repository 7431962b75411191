"""Elias-Fano sequences in NumPy: vectorised access and successor search.

A monotone sequence of n values below u keeps its floor(log2(u/n)) low bits
packed, and its high parts in unary: value i sets bit (high + i).  ``access``
selects set bits; ``find`` selects clear bits to get the run of values with the
same high part, then searches the low parts of that run.
"""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _SELECT[byte, k]: the place of the k-th set bit of the byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i
_U = np.uint64
#: Runs of equal high parts that are searched one by one.
_FEW = 8
#: Values that are worked on together, a multiple of 64: temporaries follow it, not the sequence.
PIECE = 1 << 18


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of values side by side in 64-bit words, one word to spare."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 2, _U)
    if not n or not width:
        return words
    for lo in range(0, n, PIECE):
        low = values[lo : lo + PIECE] & _U((1 << width) - 1)
        own = words[lo * width >> 6 :]
        at = np.arange(len(low), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        own[word[starts]] += np.add.reduceat(low << shift, starts)
        over = (at & 63) + width > 64
        if over.any():
            own[word[over] + 1] += low[over] >> (_U(64) - shift[over])
    return words


def unpack_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), _U)
    at = index.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(_U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << width) - 1)


class EliasFano:
    """``header``: count and low width; ``low``, ``high``, ``ranks``: the arrays."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = pack_bits(values, width)
        last = int(values[-1]) >> width if n else 0
        bits = np.zeros((last + n + 2 + 63) // 64 * 64, np.uint8)
        for lo in range(0, n, PIECE):
            highs = (values[lo : lo + PIECE] >> _U(width)).astype(np.int64)
            bits[highs + np.arange(lo, lo + len(highs))] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, width, low, high, ranks)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ranks]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:4])

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th set (or clear) bits, counted from 0."""
        if zeros:
            before = (np.arange(len(self.ranks), dtype=np.int64) << 6) - self.ranks  # clear bits before each word
            word = np.searchsorted(before, k, side="right") - 1
            rest = k - before[word]
            bits = ~self.high[word]
        else:
            word = np.searchsorted(self.ranks, k, side="right") - 1
            rest = k - self.ranks[word]
            bits = self.high[word]
        place = word << 6
        for half in (32, 16, 8):
            part = bits & _U((1 << half) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            up = rest >= count
            rest = np.where(up, rest - count, rest)
            bits = np.where(up, bits >> _U(half), part)
            place = place + np.where(up, half, 0)
        return place + _SELECT[bits.astype(np.int64) & 255, np.clip(rest, 0, 7)]

    def access(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, _U)
        high = (self._select(index, False) - index).astype(_U)
        return high << _U(self.width) | unpack_bits(self.low, index, self.width)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1; the first index where it stands twice."""
        values = np.asarray(values, _U)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        highs = (values >> _U(self.width)).astype(np.int64)
        most = (len(self.high) << 6) - self.n - 1
        todo = np.flatnonzero((highs >= 0) & (highs < most))
        if not len(todo):
            return out
        wanted, highs = values[todo] & _U((1 << self.width) - 1), highs[todo]
        begin = np.where(highs > 0, self._select(np.maximum(highs - 1, 0), True) + 1 - highs, 0)
        end = self._select(highs, True) - highs
        low = begin.copy()
        if int((end - begin).max(initial=0)) <= _FEW:
            live = np.flatnonzero(low < end)
            while len(live):
                live = live[unpack_bits(self.low, low[live], self.width) < wanted[live]]
                low[live] += 1
                live = live[low[live] < end[live]]
        else:
            high = end
            for _ in range(int((end - begin).max()).bit_length()):
                mid = (low + high) >> 1
                less = (unpack_bits(self.low, np.minimum(mid, self.n - 1), self.width) < wanted) & (low < high)
                low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(mid, high))
        good = low < end
        at = np.minimum(low, self.n - 1)
        good &= unpack_bits(self.low, at, self.width) == wanted
        out[todo[good]] = low[good]
        return out
