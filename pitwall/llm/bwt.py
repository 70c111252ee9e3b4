"""Which 50-byte strings repeat, from a Burrows-Wheeler transform of many short texts.

The longest common prefixes of neighbouring suffixes are found in increasing value:
all suffixes form the interval of the empty string, and an interval of a string is
extended backward by every symbol that precedes it. The end of an interval that is
met for the first time at length v has a common prefix of v - 1 with its successor.
An interval that ends where one ended before brings nothing new and is dropped. The
expansion stops at the minimum length: ends never met have that prefix or a longer
one in common.
"""

from __future__ import annotations

import numpy as np

from pitwall.llm.common import ragged

STOP = 0xFF  # in no UTF-8 text


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions in the order of their first ``depth`` bytes or more, by prefix doubling."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i:i + n]
    known = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if known >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order
        later = np.full(n, -1, np.int64)
        later[:max(0, n - known)] = rank[known:]
        key = rank * (n + 1) + later + 1
        known *= 2


def repeats(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether it has ``length`` bytes in common with the place before."""
    n = len(text)
    order = suffix_order(text, length + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # where the suffix that is one symbol longer stands; the whole text wraps to the last
    first = text[order]
    met = np.zeros(n + 1, bool)  # met[i]: places i - 1 and i have fewer than ``length`` bytes in common
    met[0] = met[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low + 1
        at = back[ragged(low, sizes)]
        of = np.repeat(np.arange(len(low)), sizes)
        if len(at) > n // 16:
            seen = np.full(n, -1, np.int64)
            seen[at] = of
            at = np.flatnonzero(seen >= 0)
            of = seen[at]
        else:
            by = np.argsort(at)
            at, of = at[by], of[by]
        symbol = first[at]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(new)
        low, high = at[starts], at[np.append(starts[1:], len(at)) - 1]
        fresh = ~met[high + 1]
        met[high[fresh] + 1] = True
        # the interval before an unmet end still has to be followed; the last of all ends at n and is always followed
        keep = fresh | (high == n - 1)
        low, high = low[keep], high[keep]
    return order, ~met[:n]
