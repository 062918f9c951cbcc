"""Word hashes and rolling hashes in numpy, shared by the operators on word sequences.

Defined results: no words give empty arrays; equal sequences give equal numbers whatever their place.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Odd multipliers of the rolling hashes, from a rule: the 64-bit hashes of small numbers.
MULTIPLIERS = [U(xxhash.xxh3_64_intdigest(f"multiplier {i}".encode()) | 1) for i in range(64)]


class WordHashes(dict):
    """64-bit hashes of words, each computed once; starts anew at ``most`` entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(h: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """One number for each run of ``n`` hashes; sums, so mix them before use."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, U)
    out = h[:size] * MULTIPLIERS[first]
    for k in range(1, n):
        out += h[k : size + k] * MULTIPLIERS[first + k]
    return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text's word hashes, sorted; with fewer words, the whole sequence as one; none without words."""
    if not len(h):
        return np.empty(0, U)
    if len(h) < n:
        return mixed(rolling(h, len(h)) + U(len(h)))
    s = mixed(rolling(h, n))
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
