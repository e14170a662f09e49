"""Image size arithmetic and pixel normalisation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import div, f32

LONGEST, PATCH, MERGE = 1540, 14, 2


def resized(w: Column, h: Column, longest: int = LONGEST) -> tuple[Column, Column]:
    """Width and height scaled so that the longer edge is ``longest`` (up as well)."""
    scale = f32(f32(longest) / f32(F.greatest(w, h)))
    return tuple(F.round(f32(f32(x) * scale).cast("double")).cast("bigint") for x in (w, h))


def padded(n: Column, multiple: int = PATCH * MERGE) -> Column:
    return div(n + (multiple - 1), multiple) * multiple


def patch_grid(pw: Column, ph: Column) -> tuple[Column, Column, Column]:
    """Patches across and down, and tokens after the 2 x 2 merge, of padded sizes."""
    across, down = div(pw, PATCH), div(ph, PATCH)
    return across, down, div(across, MERGE) * div(down, MERGE)


def normalised(pixels: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(pixels, lambda p: (p / F.lit(255.0) - F.lit(mean)) / F.lit(std))
