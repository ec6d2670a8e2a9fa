"""Word shingle sets of whole texts: ASCII lower case, words split at ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

from pulsemark.llm.common import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word in order; bytes.lower and bytes.split follow ASCII alone."""
    if not text:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_sequence(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; the whole sequence counts as one when it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out *= _STEP
        out += words[k : n - width + 1 + k]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_sequence(word_hashes(text), size))
