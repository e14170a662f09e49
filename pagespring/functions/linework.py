"""Text lines of one page image in numpy: the same definitions as ``operators.raster`` has
for pixel relations, for whole pages on the workers."""

from __future__ import annotations

import numpy as np

WINDOW, BIAS, REACH, LEAST, SHARE = 41, 5, 3, 10, 0.008


def boxes(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values in the box around each place, clipped at the borders."""
    h, w = values.shape
    whole = np.zeros((h + 1, w + 1), np.int64)
    whole[1:, 1:] = values.cumsum(0, dtype=np.int64).cumsum(1)
    top, bottom = (np.clip(np.arange(h) + d, 0, h) for d in (-radius, radius + 1))
    left, right = (np.clip(np.arange(w) + d, 0, w) for d in (-radius, radius + 1))
    s = whole[bottom][:, right] - whole[top][:, right] - whole[bottom][:, left] + whole[top][:, left]
    return s, (bottom - top)[:, None] * (right - left)[None, :]


def foreground(gray: np.ndarray, window: int = WINDOW, bias: int = BIAS) -> np.ndarray:
    """Where gray is below the integer mean of its box less the bias."""
    s, n = boxes(gray, window // 2)
    return gray < s // n - bias


def dilated(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    return boxes(mask.astype(np.uint8), radius)[0] > 0


def smoothed(rows: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Integer mean of 2 * reach + 1 rows; the first and last ``reach`` as they were."""
    width, out = 2 * reach + 1, rows.copy()
    if len(rows) >= width:
        upto = np.concatenate([[0], np.cumsum(rows)])
        out[reach : len(rows) - reach] = (upto[width:] - upto[:-width]) // width
    return out


def line_spans(gray: np.ndarray, least: int = LEAST, share: float = SHARE) -> list[tuple[int, int]]:
    """(y1, y2) of the text lines of a gray page, y2 exclusive, from the top."""
    rows = smoothed(dilated(foreground(gray)).sum(1).astype(np.int64))
    above = rows > int(np.float32(gray.shape[1]) * np.float32(share))
    edge = np.diff(np.concatenate([[0], above.view(np.int8), [0]]))
    spans = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    return [(a, b) for a, b in spans if b - a >= least]


def crop_rows(y1: int, y2: int, height: int) -> tuple[int, int]:
    top = min(y1, max(height - 1, 0))
    return top, max(min(y2, height), top + 1)
