"""Words, and sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries that a worker's memory of word hashes may hold; it is then begun anew.
MEMORY = 400_000


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased; none for null."""
    # Methods of bytes know ASCII only: exactly these letters and these white spaces.
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word; a bounded memory of a pure function."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _odd(n: int) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_64_digest(b"shingle%d" % i) for i in range(n)), ">u8").astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingles of ``width`` words, sorted.

    Fewer words than that are one shingle, which no longer text has; no words give no shingle.
    """
    n = len(hashes)
    if not n:
        return hashes
    size = min(n, width)
    by = _ODD[:size]
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * by[i]
    return np.unique(mixed(total))


_ODD = _odd(64)
