"""Word and window hashes of whole batches of texts, as numpy arrays.

A word is a run of bytes that are digits, a-z (A-Z counts as a-z) or not ASCII. One pass over the joined bytes of a batch
gives the places of all words; a polynomial over prefix sums gives their 64-bit hashes, without a loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[base] = found
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * _MIX_1
    h = (h ^ (h >> np.uint64(33))) * _MIX_2
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a batch: `data` bytes, word k at data[begin[k]:end[k]], words of text t are first[t]:first[t + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def phrase(self, k: int, n: int) -> bytes:
        """Words k .. k + n - 1 joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.begin[k : k + n], self.end[k : k + n], strict=True))


def find_words(texts: list[str | None]) -> Words:
    """The words of the texts; null has none."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([b"", *parts, b""]), dtype=np.uint8)]
    flags = _WORD[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    begin, end = edges[0::2], edges[1::2]
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    first = np.searchsorted(begin, bounds)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(_BASE, len(data)), out=sums[1:])
    h = (sums[end] - sums[begin]) * _table(_INVERSE, len(data))[begin]
    return Words(data, begin, end, first, mix(h ^ (end - begin).astype(np.uint64)))


def window_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n words in a row, also across texts; window k starts at word k."""
    if len(word_hash) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(word_hash) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _STEP + word_hash[k : len(word_hash) - n + 1 + k]
    return mix(out ^ np.uint64(n))
