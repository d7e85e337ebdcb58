"""Hashed word-shingle sets of texts (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_REMEMBERED = 200_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes.

    A-Z is lower-cased; words are runs of bytes other than space and \\t..\\r
    (``bytes.split``). Fewer than ``width`` words make one shingle; no word,
    none. Two different shingles share a hash with a chance of 2**-64.
    """

    def __init__(self, width: int):
        if not 1 <= width <= len(_MULTIPLIERS):
            raise ValueError(f"width must be 1 to {len(_MULTIPLIERS)}")
        self.width, self._word = width, _WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, "u8")
        w = np.fromiter(map(self._word.__getitem__, words), "u8", len(words))
        k = min(self.width, len(w))
        out = np.full(len(w) - k + 1, k, "u8")  # the width sets short sequences apart
        for i in range(k):
            out = (out ^ w[i:len(w) - k + 1 + i]) * np.uint64(_MULTIPLIERS[i])
            out ^= out >> np.uint64(29)
        return np.unique(out)


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
