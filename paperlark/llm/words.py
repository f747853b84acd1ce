"""Hashes of words and of runs of words, for many texts at once with numpy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A to Z in lower case. A word's hash is a polynomial
of its bytes modulo 2 ** 64, taken from running sums, then mixed; hashes of different words are equal with chance 2 ** -64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = 1 << 18
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    return np.cumprod(out, dtype="uint64")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, one text after the other, and the number of words of each text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", "uint8")
    ends = np.cumsum([len(p) + 1 for p in parts])
    inverse = pow(BASE, -1, 1 << 64)
    hashes, starts, low = [], [], 0
    while low < len(data):
        high = min(low + _WINDOW, len(data))
        while high < len(data) and not _IS_SPACE[data[high - 1]]:  # to the end of a word
            more = np.flatnonzero(_IS_SPACE[data[high : high + _WINDOW]])
            high = min(len(data), high + (int(more[0]) + 1 if len(more) else _WINDOW))
        some = _LOWER[data[low:high]]
        space = _IS_SPACE[some]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        last = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        if len(last) < len(first):
            last = np.append(last, len(some))
        n = max(_WINDOW, 1 << int(len(some)).bit_length())
        sums = np.concatenate((np.zeros(1, "uint64"), np.cumsum((some.astype("uint64") + np.uint64(1)) * _powers(BASE, n)[: len(some)], dtype="uint64")))
        h = (sums[last] - sums[first]) * _powers(inverse, n)[first]
        hashes.append(mix(h ^ ((last - first).astype("uint64") * np.uint64(BASE))))
        starts.append(first + low)
        low = high
    at = np.searchsorted(ends, np.concatenate(starts), "right") if starts else np.empty(0, "int64")
    return np.concatenate([*hashes, np.empty(0, "uint64")]), np.bincount(at, minlength=len(texts))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbouring words of one text; of a shorter text, one of all its words; of none, none."""
    if not len(words):
        return words
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, "uint64")
    for i in range(n):
        out = mix(out * np.uint64(BASE) + words[i : len(words) - n + 1 + i])
    return out
