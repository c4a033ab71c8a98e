"""Rolling hashes of k-grams over many sequences at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 .. n - 1, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = (n + 0xFFFF) >> 16 << 16
        _powers[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=U))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other; in place."""
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` values; run i begins at value i.  Equal runs have equal hashes."""
    n = len(values)
    if n < k:
        return np.empty(0, U)
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    x = values.astype(U)
    x += U(1)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(29)
    np.cumsum(np.multiply(x, up, out=x), out=sums[1:])
    h = sums[k:] - sums[: n - k + 1]
    h *= down[: n - k + 1]
    return mix(h)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of `w` keys, by doubling."""
    m, s = keys, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if s < w else m


class Prefix:
    """Hashes of any spans of one sequence."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        x = values.astype(U)
        x += U(1)
        x *= U(0xA0761D6478BD642F)
        x ^= x >> U(29)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(np.multiply(x, up[:-1], out=x), out=self.sums[1:])

    def span(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of each span; it tells spans of different size apart."""
        h = (self.sums[start + size] - self.sums[start]) * self.down[start]
        return mix(h + size.astype(U) * U(0x9E3779B97F4A7C15))
