"""Rolling hashes of byte strings with numpy.

A prefix sum of table[byte] * base**position, in whole numbers modulo 2**64,
gives the hash of any substring by one difference and one multiplication by the
base's inverse power. The tables are fixed, so hashes agree between tasks.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each value's bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Roller:
    """Substring hashes under one random table and base."""

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _room(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, base & _MASK, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._room(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]
