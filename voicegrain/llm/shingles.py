"""Hashes of word shingles, computed over a whole text at once."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        found = np.multiply.accumulate(np.full(max(n, 4096), base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))
        _powers[int(base)] = found
    return found[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in its place. The text is read in pieces that end between words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    space = IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        n = int(ends[last - 1] - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[low : low + n].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((total[b] - total[a]) * powers(INVERSE, n + 1)[a])
        first = last
    return out


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; a shorter text is one shingle, one without words none."""
    h = word_hashes(text or "")
    k = min(words, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    code = np.zeros(n, np.uint64)
    for i in range(k):
        code = mixed(code + h[i : i + n] + np.uint64(i))
    return np.unique(code)
