"""Hashes of words and of word windows, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 200_000

_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hash by word; forgets all words when it holds ``WORDS_KEPT``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """The same numbers with their bits spread; one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (polynomial, modulo 2^64) of every ``width`` consecutive values.

    Windows of twice a size are made from two of that size, and those of the binary digits of
    ``width`` are put together, which takes a step per digit instead of one per word.
    """
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total, covered = np.zeros(count, np.uint64), 0
    piece, size, factor = values, 1, _BASE
    while True:
        if width & size:
            total = total * np.uint64(factor) + piece[covered : covered + count]
            covered += size
        if 2 * size > width:
            return mixed(total)
        piece = piece[:-size] * np.uint64(factor) + piece[size:]
        size, factor = 2 * size, factor * factor & _WRAP
