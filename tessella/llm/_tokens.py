"""Words as numpy arrays over the UTF-8 bytes of a batch: a word is a longest run of [^\\x20\\x09-\\x0D]."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value a byte, and an odd base: a word's hash is the sum of VALUE[byte] * BASE ** place, mod 2 ** 64.
VALUE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64; kept and doubled as longer batches come."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 24:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of each word, and the number of words before each document (n + 1 long)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k successive words inside a document, and how many come before each document.

    Repeats included; a document with 1 to k - 1 words gives its whole sequence, one without words nothing.
    """
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(counts)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.arange(before[-1]) - before[doc] + bounds[doc]
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < bounds[doc + 1]
        term = hashes[np.minimum(at + j, len(hashes) - 1)] + np.uint64(j + 1)
        out = np.where(inside, mix(out * np.uint64(BASE) + term), out)
    return out, before
