"""Hashes of many byte ranges at once, with array operations."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_powers: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random odd number for each byte value.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT) | np.uint64(1)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """``base ** i`` mod 2**64 for i < n."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        x = np.full(max(n, 1), base, np.uint64)
        x[0] = 1
        x = np.cumprod(x, dtype=np.uint64)
        if n > 8_000_000:
            return x
        _powers[key] = x
    return _powers[key][:n]


class RangeHash:
    """Polynomial hashes mod 2**64 of any ranges of one byte array; equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray, base: int):
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(n, np.uint64(base)), out=self.sums[1:])
        self.back = powers(n + 1, self.inverse)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def blocks(offsets: np.ndarray, most: int):
    """Row ranges whose bytes are at most ``most``, or single longer rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
