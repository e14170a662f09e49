"""Word shingles of whole texts as 64-bit values, for batches of texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z count as a-z


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit values (the splitmix64 finaliser), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))
    return _POWERS[0], _POWERS[1]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings or bytes and the texts' limits in them; null is empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(column, rows: int, size: int) -> list[tuple[int, int]]:
    """(from, to) of the texts to take together: ``rows`` and ``size`` bytes at most, one at least."""
    ends = flat(column)[1]
    out, at = [], 0
    while at < len(column):
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
        out.append((at, to))
        at = to
    return out


def word_hashes(raw: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the texts' limits among the words; ``space`` marks
    the bytes that part words."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~space[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]  # words do not cross texts
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    h ^= (e - s).astype(np.uint64) * _WORD[63]
    return mix64(h), np.searchsorted(s, ends)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and the texts' limits.

    A text of fewer words than ``width`` has its whole sequence as one shingle, a text
    without words none.
    """
    words, at = word_hashes(raw, ends)
    n = np.diff(at)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    limits = np.concatenate([[0], np.cumsum(counts)])
    total = int(limits[-1])
    text = np.repeat(np.arange(len(n)), counts)
    first = np.arange(total) - limits[text] + at[text]
    h = np.zeros(total, np.uint64)
    length = np.minimum(n, width)[text]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[first + k] * _WORD[k]
        part[k >= length] = 0
        h += part
    h += length.astype(np.uint64) * _WORD[62]
    h = mix64(h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))
