"""Words and word shingles as 64-bit hashes, for use in tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import in_worker

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words whose hash a Python worker remembers.
WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    """The worker's own, in place of what another operator left there."""
    return in_worker("words", WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of `width` words. Words are what ASCII white space parts, A-Z
    lower-cased; a text of fewer words has one shingle, the whole sequence; one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(s)
