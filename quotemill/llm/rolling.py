"""Polynomial hashes over byte buffers, vectorised: prefix hashes, hashes of windows, common extensions.

Bytes are mapped to random 64-bit values and summed with powers of an odd base modulo 2^64; the hash of any range is a
difference of two prefix sums times an inverse power. Equal strings have equal hashes; callers verify what equal hashes claim.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


class Rolling:
    """Tables of one base: values of bytes, powers and inverse powers, grown as needed."""

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.values = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
            self.base = (mix(np.array([seed + 17], dtype=_U)) | _U(1))[0]
            inverse = self.base
            for _ in range(6):  # Newton: doubles the correct bits
                inverse = inverse * (_U(2) - self.base * inverse)
        self.inverse = inverse
        self.up = self.down = np.ones(1, dtype=_U)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, len(self.up) + (1 << 18))
            with np.errstate(over="ignore"):
                for name, x in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, x, dtype=_U)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte buffer, one longer than it."""
        self._tables(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, stop), comparable wherever they lie."""
        with np.errstate(over="ignore"):
            return (prefix[stop] - prefix[start]) * self.down[start]

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` bytes."""
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, dtype=_U)
        with np.errstate(over="ignore"):
            return (prefix[size:] - prefix[:n]) * self.down[:n]

    def common(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair of positions, up to ``most``: binary search over hashes."""
        low = np.zeros(len(a), dtype=np.int64)
        high = most.astype(np.int64).copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.ranges(prefix, a, a + middle) == self.ranges(prefix, b, b + middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)


FIRST = Rolling(0x5DEECE66D)
