"""Words and word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that one worker remembers before it starts afresh.
MEMO_ENTRIES = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed values: odd constants of a 64-bit mixer
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """Word -> hash, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased: what bytes.split and bytes.lower do to UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of each run of `size` words; fewer words make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _MULTIPLIER + hashes[i : n - width + 1 + i]
    return mix(out)
