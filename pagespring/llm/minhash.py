"""Signatures by circulant MinHash."""

from __future__ import annotations

import numpy as np

from .shingles import mix64

_FIRST = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)
_SPREAD = np.uint64(0xE7037ED1A0B428DB)


def signatures(h: np.ndarray, limits: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima a set; sets are slices of ``h`` and not empty.

    Two permutations of the 64-bit universe: the first shuffles the shingles once; the
    second, circularly shifted by k, gives coordinate k.
    """
    shuffled = mix64(h ^ _FIRST)
    starts = limits[:-1]
    out = np.empty((len(starts), coordinates), np.uint64)
    block = max(1, 65536)
    # blocks of whole sets that stay in the processor's cache
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(limits, limits[at] + block, "right")) - 1)
        x = shuffled[limits[at] : limits[to]]
        cut = starts[at:to] - limits[at]
        for k in range(coordinates):
            shifted = (x + np.uint64(k)) ^ _SECOND
            out[at:to, k] = np.minimum.reduceat(mix64(shifted), cut)
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band (its number is mixed in), as signed values."""
    keys = np.zeros((len(signature), bands), np.uint64)
    keys += np.arange(1, bands + 1, dtype=np.uint64) * _SPREAD
    for r in range(rows):
        keys = mix64((keys ^ signature[:, r : bands * rows : rows]) + _SECOND)
    return keys.view(np.int64)
