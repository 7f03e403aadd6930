"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: Sequence[Sequence[bytes]]) -> list[np.ndarray]:
    """64-bit hash of every word of every text; a distinct word is hashed once."""
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    if len(flat) == 0:
        return [np.empty(0, np.uint64) for _ in words]
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    every = hashed[flat.indices.to_numpy(zero_copy_only=False)]
    return np.split(every, np.cumsum([len(ws) for ws in words])[:-1])


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of ``width`` words; the whole sequence where it
    is shorter, nothing where it is empty."""
    if len(hashes) == 0:
        return hashes
    n = min(width, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * _MULTIPLIER + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix(total))
