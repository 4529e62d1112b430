"""Elias-Fano code of a non-decreasing sequence, with select.

Of each value the low ``l`` bits are packed as they are; the high bits are written
in unary, one set bit a value, so that value ``i`` is ``(select1(i) - i) << l`` plus
its low bits.  With ``l = floor(log2(U / n))`` that is at most 2 + log2(U / n) bits
a value.  Select needs a directory, the number of set bits before every 512 high bits;
it is stored with the code (as differences to a straight line, in as few bytes as they
take) and is not counted again when a code is opened.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64  # bytes of high bits between two counts


def _narrowed(counts: np.ndarray) -> tuple[int, int, bytes]:
    """(slope, bytes a number, numbers): how far each count lies from a straight line."""
    slope = int(counts[-1]) // max(1, len(counts) - 1)
    off = counts.astype(np.int64) - slope * np.arange(len(counts))
    for width in (1, 2, 4, 8):
        if np.abs(off).max(initial=0) < 1 << (8 * width - 1):
            return slope, width, off.astype(f"<i{width}").tobytes()
    raise OverflowError


class EliasFano:
    HEAD = struct.Struct("<QBQQQBQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(high).astype(np.int64)
        padded = np.append(ones, np.zeros(-len(ones) % STEP, np.int64))
        return cls(n, low_bits, low, high, np.concatenate([[0], np.cumsum(padded.reshape(-1, STEP).sum(axis=1))]))

    def tobytes(self) -> bytes:
        slope, width, numbers = _narrowed(self.counts)
        head = self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), slope, width, len(self.counts))
        return head + numbers + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at ``at`` and the place after it."""
        n, low_bits, a, b, slope, width, k = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        counts = np.frombuffer(data, f"<i{width}", k, at).astype(np.int64) + slope * np.arange(k)
        at += k * width
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, counts), at + a + b

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """Value ``i`` without decoding the others."""
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values ``i`` to ``j - 1``: of the high bits only the blocks they lie in are
        decoded."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.counts, i, "right")) - 1
        last = int(np.searchsorted(self.counts, j - 1, "right"))
        ones = np.flatnonzero(np.unpackbits(self.high[first * STEP : last * STEP], bitorder="little"))
        skip = i - int(self.counts[first])
        at = first * STEP * 8 + ones[skip : skip + j - i]
        nth = np.arange(i, j)
        return ((at - nth).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(nth)

    def last_at_most(self, value: int) -> int:
        """How many values are at most ``value``, by bisection with select."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) <= value:
                low = middle + 1
            else:
                high = middle
        return low
