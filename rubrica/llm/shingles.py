"""Word shingles as 64-bit hashes, and counting of hashed items over the whole table in packed blocks."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
WORDS_KEPT = 50_000  # at most twice as many, about 20 MB, are held by a worker


class _Words(dict):
    """64-bit hashes of words. When it holds WORDS_KEPT, all but those used since it was last full are forgotten."""

    def __init__(self):
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        h = self.older.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


_words = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased; bytes split on exactly the white space that ends a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes, in order."""
    out = np.full(max(0, len(words) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * _M[0] + words[k : len(words) - n + 1 + k])
    return out


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """A text's distinct n-word shingles, ascending; with fewer words the whole sequence is one; none without words."""
    words = word_hashes(text)
    return np.unique(ngrams(words, min(n, len(words)))) if len(words) else words
