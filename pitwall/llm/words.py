"""Words of many texts at once, as runs of bytes with 64-bit hashes."""

from __future__ import annotations

import numpy as np

# A-Z become a-z; every other byte, and so every other character, stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def classes(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind that stay inside a document: starts, ends, document."""
    n = len(kind)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    inner = offsets[:-1][offsets[:-1] < n]
    change[inner] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, 2 * len(known)), base, np.uint64)
        steps[0] = 1
        _powers[base] = known = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes (or wider units); equal runs have equal hashes in every batch."""
    values = _VALUE[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64)) | np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(data)), out=total[1:])
    back = _power(_INVERSE, len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words that start at each position; the last k - 1 positions are missing."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, salt + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return mix(out)


def winnow(h: np.ndarray, doc: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions whose hash is the least, rightmost of equals, in some window of grams.

    ``doc`` is the document of each word; windows stay inside one document.
    """
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h[:n].copy(), np.zeros(n, np.int16)
    for j in range(1, window):
        lower = h[j:j + n] <= best
        best[lower] = h[j:j + n][lower]
        at[lower] = j
    last = window + k - 2
    inside = doc[:n] == doc[last:last + n]
    picked = np.zeros(len(h), bool)
    picked[(np.arange(n) + at)[inside]] = True
    return np.flatnonzero(picked)
