"""Words of a text as 64-bit hashes in numpy, for tasks that look at runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a task remembers before it starts afresh.
MEMORY = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class WordHashes(dict):
    """Hash of a word, computed once while the word is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of every value over all 64."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for every run of ``length`` words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(length):
            out += mixed(hashes[i : i + n] * _ODD[i % 4] + factor)
            factor = factor * _ODD[0] + _ODD[1]
            out *= _ODD[2]
        return mixed(out)
