"""Words and word hashes of whole texts, on UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that end a word of letters and digits (the class
#: [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing) become blanks, A-Z become a-z.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def blank_words(text: str | None) -> list[bytes]:
    """Runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all beyond ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
