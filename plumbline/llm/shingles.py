"""Hashes of five-word shingles, stable from process to process."""

from __future__ import annotations

import numpy as np
import xxhash

from .stores import kept

WORDS = 5
#: Word hashes kept in a worker; beyond it the store starts anew.
STORE = 80_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """A hash for each run of ``n`` words (white space separates words); one of all words, if they are fewer; none without words."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    store = kept("words", _Hashes)
    if len(store) > STORE:
        store.clear()
    w = np.fromiter(map(store.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        out = (out + w[i : len(w) - n + 1 + i]) * GOLDEN
    return mix(out + np.uint64(n))
