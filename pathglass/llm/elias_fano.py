"""Elias-Fano coding of non-decreasing sequences, with select.

``n`` values up to ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits
of each value stand in a packed array, the high bits as gaps in unary. Value
``i`` is the place of the ``i``-th one in the unary part, found from a sample of
every 64th one and a scan of the few bytes behind it.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQQ")  # count, low width, upper bytes, samples
SAMPLE = 64
#: Values whose low bits are laid out at a time.
PART = 1 << 13


class EliasFano:
    def __init__(self, n: int, width: int, low: bytes, upper: bytes, samples: np.ndarray):
        self.n, self.width, self.low, self.upper, self.samples = n, width, low, upper, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        """``values``: non-decreasing integers from 0 to 2**64 - 1."""
        x = np.asarray(values)
        if len(x) and x.dtype.kind != "u" and int(x.min()) < 0 or (x[1:] < x[:-1]).any():
            raise ValueError("values must be non-negative and non-decreasing")
        x, n = x.astype(np.uint64), len(x)
        if n == 0:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        width = max(0, (int(x[-1]) // n).bit_length() - 1)
        places = np.arange(width, dtype=np.uint64)
        # Parts of a multiple of eight values end at a byte, and keep the table of bits small.
        parts = [((x[k : k + PART, None] >> places) & np.uint64(1)).astype(np.uint8).ravel() for k in range(0, n, PART)] if width else []
        low = b"".join(np.packbits(bits, bitorder="little").tobytes() for bits in parts)
        ones = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1, np.uint8)
        upper[ones] = 1
        return cls(n, width, low, np.packbits(upper, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.width, len(self.upper), len(self.samples))
        return head + self.low + self.upper + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at ``data[at:]`` and where it ends."""
        n, width, n_upper, n_samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        n_low = (n * width + 7) // 8
        low, upper = bytes(data[at : at + n_low]), bytes(data[at + n_low : at + n_low + n_upper])
        at += n_low + n_upper
        samples = np.frombuffer(data, "<u4", n_samples, at)
        return cls(n, width, low, upper, samples), at + 4 * n_samples

    def select(self, i: int) -> int:
        """The ``i``-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        # Ones before the sampled one, in its byte, do not count.
        bits = self.upper[byte] >> (place & 7) << (place & 7)
        while left >= (ones := bits.bit_count()):
            left -= ones
            byte += 1
            bits = self.upper[byte]
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        start = i * self.width
        chunk = int.from_bytes(self.low[start >> 3 : (start + self.width + 7) >> 3], "little") >> (start & 7)
        return (place - i) << self.width | chunk & ((1 << self.width) - 1)
