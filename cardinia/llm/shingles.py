"""Word shingles of a text as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

WIDTH = 5
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: An odd number, whose powers tell a word's place in its shingle.
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words (A-Z only) between runs of ASCII white space."""
    # bytes.split() cuts at just the six ASCII blanks that the contract names.
    return (text or "").encode().translate(_UPPER).split()


def class_key(words: list[bytes]) -> int:
    """64 bits that texts with the same words in the same order share."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=64)
def _place(i: int) -> int:
    return pow(_BASE, i + 1, 1 << 64)


class Shingler:
    """Hashes the shingles of ``width`` words."""

    def __init__(self, width: int = WIDTH):
        self.width = width

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct shingle hashes in rising order (uint64); no words: none; few words: one."""
        if not words:
            return np.zeros(0, np.uint64)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        # Word hashes times the odd number of their place: equal sums of different words are as rare as equal hashes.
        k = min(self.width, len(h))
        n = len(h) - k + 1
        total = np.full(n, np.uint64(len(h) if len(h) < self.width else 0))
        for i in range(k):
            total += h[i : i + n] * np.uint64(_place(i))
        out = np.sort(_mixed(total))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]
