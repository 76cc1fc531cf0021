"""Word splitting and 64-bit hashing shared by the text operators (NumPy, executor side)."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest, xxh3_128_digest

_MUL = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of characters other than space and \\x09-\\x0D, as UTF-8; null gives none.

    ``lower`` maps A-Z only. ``bytes.split()`` separates at exactly those six characters.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def wide_hashes(words: list[bytes]) -> np.ndarray:
    """128-bit digests of the words, as two columns."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; empty when there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + _MUL) ^ h[i : i + n]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, no words are none."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    return np.unique(rolling(h, min(k, len(h))))
