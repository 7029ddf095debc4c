"""Elias-Fano coding of a non-decreasing sequence of integers, with select.

Each of n values up to u keeps its `low` lowest bits in a packed array; the rest is written in unary as a bit vector in
which the i-th one stands at (value >> low) + i. That takes about 2 + log2(u / n) bits a value. The positions of every
SAMPLE-th one are kept, so that select reads one short stretch of the bit vector.
"""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones, the position of one is stored.
SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")  # values, largest value, low bits, words of the low part, words of the high part

_BITS_OF_BYTE = np.array([bin(k).count("1") for k in range(256)], np.uint8)


class EliasFano:
    """A coded sequence; len() and [] as for a list, all() for every value at once."""

    def __init__(self, n: int, top: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.lows, self.highs, self.samples = n, top, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: non-decreasing, not negative."""
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        if low:
            shifts = np.arange(low, dtype=np.uint64)
            bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1)
            lows = np.packbits(bits, bitorder="little")
        else:
            lows = np.zeros(0, np.uint8)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(highs, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, top, low, lows, highs, ones[::SAMPLE].astype("<u8"))

    def __len__(self) -> int:
        return self.n

    def _select(self, k: int) -> int:
        """Position of the k-th one of the high part."""
        at = int(self.samples[k // SAMPLE])
        left, byte = k % SAMPLE, at >> 3
        word = int(self.highs[byte]) >> (at & 7) << (at & 7)  # ones before the sample don't count
        while (own := int(_BITS_OF_BYTE[word])) <= left:
            left -= own
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        high = self._select(k) - k
        if not self.low:
            return high
        first = k * self.low
        word = int.from_bytes(self.lows[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return high << self.low | (word >> (first & 7)) & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.top, self.low, len(self.lows), len(self.highs)) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low, a, b = _HEAD.unpack_from(data)
        at = _HEAD.size
        lows, highs = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, top, low, lows, highs, np.frombuffer(data, "<u8", -(-n // SAMPLE), at + a + b))
