"""Elias-Fano coding of a non-decreasing sequence, with select.

n values up to u take about n * (2 + log2(u / n)) bits: the low bits of each
value are packed, the high bits are a unary bit vector with one set bit per
value.  Value i is read from the place of the i-th set bit, which is found from
a sample of 32-bit places, one for every SAMPLE set bits.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")  # values, bound, low bits, bytes of low part, bytes of high part


def encode(values: np.ndarray) -> bytes:
    v = np.ascontiguousarray(values, np.uint64)
    n, bound = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (bound // max(n, 1)).bit_length() - 1)
    high_bits = np.zeros(n + (bound >> low) + 1, np.uint8)
    places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high_bits[places] = 1
    if low:
        lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low_part = np.packbits(lows.ravel(), bitorder="little").tobytes()
    else:
        low_part = b""
    high_part = np.packbits(high_bits, bitorder="little").tobytes()
    if len(high_bits) >= 1 << 32:
        raise ValueError("a shard holds too many documents for 32-bit samples")
    return _HEAD.pack(n, bound, low, len(low_part), len(high_part)) + low_part + high_part + places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, raw: bytes):
        self.n, self.bound, self.low, nl, nh = _HEAD.unpack_from(raw)
        at = _HEAD.size
        self.low_part = np.frombuffer(raw, np.uint8, nl, at)
        self.high_part = np.frombuffer(raw, np.uint8, nh, at + nl)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + nl + nh)

    def __len__(self) -> int:
        return self.n

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.uint64)
        a, b = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.low_part[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return (bits.reshape(count, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i, 1)[0])

    def block(self, first: int, count: int) -> np.ndarray:
        """Values first .. first + count - 1, reading the high part from the sample before first only as far as needed."""
        count = min(count, self.n - first)
        if count <= 0:
            return np.zeros(0, np.uint64)
        k = first // SAMPLE
        at = int(self.samples[k]) // 8
        last = (first + count - 1) // SAMPLE + 1
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high_part)
        ones = np.flatnonzero(np.unpackbits(self.high_part[at:end], bitorder="little")) + at * 8
        skip = int(np.searchsorted(ones, int(self.samples[k]))) + first - k * SAMPLE
        places = ones[skip : skip + count]
        high = (places - np.arange(first, first + count)).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._lows(first, count)
