"""64-bit hashes of words, remembered within a task up to a bound."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash

REMEMBERED = 200_000


class WordHashes(dict):
    """Maps words to hashes of their normal form; 0 where nothing is left of a word."""

    def __init__(self, normal_form: Callable[[str], str] | None = None) -> None:
        super().__init__()
        self._normal_form = normal_form

    def __missing__(self, word: str | bytes) -> int:
        normal = self._normal_form(word) if self._normal_form else word
        value = (xxhash.xxh64_intdigest(normal) or 1) if normal else 0
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value

    def of(self, words: Sequence) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value (64-bit finaliser)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def multipliers(count: int) -> np.ndarray:
    """Odd numbers without visible pattern."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
