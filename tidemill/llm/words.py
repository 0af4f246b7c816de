"""Words and their hashes, shared by the operators that work on word sequences.

A word is a maximal run of bytes other than space and the control characters 9 to 13; on UTF-8 that is just what
``bytes.split`` does, and ``bytes.lower`` lower-cases A-Z only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

REMEMBERED_WORDS = 100_000


class WordHashes(dict):
    """The 64-bit hash of each word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxh64_intdigest(word)
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The one of this process, so that groups of one task share what it remembers."""
    return WordHashes()


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that any bits of the result can serve as a hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words; of fewer words, the hash of the whole sequence."""
    n = len(hashes)
    if not n:
        return hashes
    length = min(size, n)
    total = hashes[: n - length + 1] + np.uint64(length)
    for k in range(1, length):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - length + 1 + k]
    return np.unique(mixed(total))
