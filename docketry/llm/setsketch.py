"""Word shingles of whole texts, and SetSketch registers of shingle sets.

A register holds OFFSET + 1 - log_b of the smallest of exponentially distributed hashes of the set, rounded down and
truncated to 16 bits; the offset keeps the registers of the smallest sets above 0. Registers of a union are the larger of the two sets' registers; equal registers are the
likelier the more two sets share. Given both sets' sizes, the numbers of registers where one, the other or neither
is larger have a likelihood that is concave in the Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

BASE = 1.001
OFFSET = 4096  # a set of one shingle has a register of 0 once in e**60 times
TOP = (1 << 16) - 1
SHINGLE = 5  # words
CACHED = 400_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_FINISH = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    for c in _FINISH:
        x = (x ^ (x >> np.uint64(33))) * c
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles; remembers the hashes of words it has met."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # ASCII alone is lowered; blanks are x20, x09 to x0D
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > CACHED:
                known.clear()
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
        h = np.array(hashes, np.uint64)
        n = len(h) - self.size + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.size):
            total = mixed(total + h[i : i + n] * _MIX[i % len(_MIX)])
        return np.unique(total)


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that are the same for the same set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Sketcher:
    """Registers from 32-bit hashes of the shingles' upper halves: multiplied by the register's odd number, then mixed."""

    def __init__(self, registers: int, seed: int = 42) -> None:
        self.multipliers = np.random.default_rng(seed).integers(1, 1 << 32, registers, dtype=np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.multipliers), (1 << 32) - 1, np.uint32)
        halves = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(halves), 256):
            x = np.multiply.outer(self.multipliers, halves[at : at + 256])
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(low, x.min(1), out=low)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
        return np.clip(np.floor(OFFSET + 1 - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the likeliest Jaccard similarity of each pair of sketches (rows) is `least` or more.

    The log-likelihood is concave, so it is the sign of its slope at `least` that tells.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    possible = np.minimum(u, v) / np.maximum(u, v) >= least
    c = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * c) / math.log(BASE)

    def slope(x: np.ndarray) -> np.ndarray:
        return c / (1 - np.clip(x, 1e-12, 1) * c) / math.log(BASE)

    x, y = u - v * least, v - u * least
    d_x, d_y = -v * slope(x), -u * slope(y)
    rest = np.maximum(1 - p(x) - p(y), 1e-12)
    return possible & (more * d_x / np.maximum(p(x), 1e-12) + less * d_y / np.maximum(p(y), 1e-12) - same * (d_x + d_y) / rest >= 0)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each sketch's bands of `rows` registers."""
    n, m = sketches.shape
    parts = sketches.astype(np.uint64).reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, m // rows)).copy()
    for i in range(rows):
        key = mixed(key * _MIX[0] + parts[:, :, i])
    return key.view(np.int64)
