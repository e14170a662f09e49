"""Pixel relations (page_id, y, x, gray) and row histograms.

Boxes over pixels go by tiles: a page is cut into squares, each pixel is sent to the squares
whose border of the box's radius it stands in, and a summed-area table per square gives the
boxes.  So a filter shuffles pixels once, a page may be larger than a task, and a task holds
(TILE + 2 radius) ** 2 pixels.  Neighbours are those by coordinate; places without a row
count for nothing, rows that share a place count each.  A pixel without a value counts as a
place, adds nothing to a sum and is neither ink nor foreground; one without y or x is left
out.  No pixels give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linework import boxes
from ..functions.numbers import div

TILE = 512


def tiles_around(axis: str, radius: int, tile: int) -> Column:
    """The tile numbers along an axis whose squares a pixel's box reaches into."""
    first, last = (F.floor((F.col(axis) + d) / tile).cast("int") for d in (-radius, radius))
    return F.sequence(first, last)


class Square:
    """The pixels that one tile sees, as a grid over the places from the least to the largest."""

    def __init__(self, table: pa.Table, key: tuple, c: str, tile: int):
        ty, tx = (int(k.as_py()) for k in key[-2:])
        y, x = (table[n].to_numpy().astype(np.int64) for n in ("y", "x"))
        self.at = (y - y.min(), x - x.min())
        self.shape = (int(self.at[0].max()) + 1, int(self.at[1].max()) + 1)
        self.own = (y // tile == ty) & (x // tile == tx)
        self.known = table[c].is_valid().to_numpy()
        self.values = table[c].fill_null(0).to_numpy().astype(np.int64)

    def grid(self, each: np.ndarray) -> np.ndarray:
        g = np.zeros(self.shape, np.int64)
        np.add.at(g, self.at, each.astype(np.int64))
        return g

    def box(self, each: np.ndarray, radius: int) -> np.ndarray:
        """For each pixel the sum over its box."""
        return boxes(self.grid(each), radius)[0][self.at]

    def foreground(self, radius: int, bias: int) -> np.ndarray:
        """Which pixels are below the integer mean of their box less the bias."""
        mean = self.box(self.values, radius) // self.box(np.ones(len(self.values)), radius)
        return self.known & (self.values < mean - bias)


def by_tiles(pixels: DataFrame, c: str, radius: int, out: str, f: Callable[[Square, pa.Table], pa.Table], tile: int = TILE) -> DataFrame:
    """f for every tile that holds a pixel, with the pixels around it; out: f's columns."""
    d = pixels.select("page_id", "y", "x", c).select("*", F.explode(tiles_around("y", radius, tile)).alias("ty")).select("*", F.explode(tiles_around("x", radius, tile)).alias("tx"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return f(Square(table, key, c, tile), table)

    return d.groupBy("page_id", "ty", "tx").applyInArrow(run, f"page_id {pixels.schema['page_id'].dataType.simpleString()}, {out}")


def _pixels(table: pa.Table, own: np.ndarray, name: str, values: np.ndarray, missing: np.ndarray | None = None) -> pa.Table:
    """The own rows of a tile with a new column of whole numbers."""
    t = table.select(["page_id", "y", "x"]).append_column(name, pa.array(values.astype(np.int32), mask=missing))
    return t.filter(pa.array(own))


def adaptive_threshold(pixels: DataFrame, window: int = 41, bias: int = 5, tile: int = TILE) -> DataFrame:
    """(page_id, y, x, value): 255 where gray < integer mean of the clipped box - bias."""
    r = window // 2

    def f(s: Square, t: pa.Table) -> pa.Table:
        return _pixels(t, s.own, "value", s.foreground(r, bias) * 255)

    return by_tiles(pixels, "gray", r, "y int, x int, value int", f, tile)


def dilate(binary: DataFrame, radius: int = 1, tile: int = TILE) -> DataFrame:
    """255 where any pixel of the clipped box is above 0."""

    def f(s: Square, t: pa.Table) -> pa.Table:
        return _pixels(t, s.own, "value", (s.box(s.values > 0, radius) > 0) * 255)

    return by_tiles(binary, "value", radius, "y int, x int, value int", f, tile)


def thicken(pixels: DataFrame, radius: int = 1, ink: int = 170, tile: int = TILE) -> DataFrame:
    """Gray 0 where any pixel of the clipped box is ink, else as it was."""

    def f(s: Square, t: pa.Table) -> pa.Table:
        near = s.box(s.known & (s.values < ink), radius) > 0
        return _pixels(t, s.own, "gray", np.where(near, 0, s.values), ~s.known & ~near)

    return by_tiles(pixels, "gray", radius, "y int, x int, gray int", f, tile)


def foreground_rows(pixels: DataFrame, window: int = 41, bias: int = 5, radius: int = 1, tile: int = TILE) -> DataFrame:
    """(page_id, y, n): the row histogram of the dilated threshold, with one shuffle of pixels
    and one of the tiles' rows: a tile's border is wide enough for both boxes."""
    r = window // 2

    def f(s: Square, t: pa.Table) -> pa.Table:
        marked = s.box(s.foreground(r, bias), radius) > 0
        y = t["y"].to_numpy()[s.own]
        rows, place = np.unique(y, return_inverse=True)
        n = np.bincount(place, weights=marked[s.own], minlength=len(rows)).astype(np.int64)
        return pa.table({"page_id": t["page_id"].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64))), "y": pa.array(rows.astype(np.int32)), "n": pa.array(n)})

    parts = by_tiles(pixels, "gray", r + radius, "y int, n long", f, tile)
    return parts.groupBy("page_id", "y").agg(F.sum("n").alias("n"))


def row_histogram(binary: DataFrame) -> DataFrame:
    """(page_id, y, n): foreground pixels of each row, rows without any included."""
    return binary.groupBy("page_id", "y").agg(F.sum((F.col("value") > 0).cast("bigint")).alias("n"))


def smooth_histogram(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Integer mean over 2 * reach + 1 rows; the first and last ``reach`` rows as they were."""
    w = Window.partitionBy("page_id").orderBy("y").rowsBetween(-reach, reach)
    full = F.count("*").over(w) == 2 * reach + 1
    return rows.select("page_id", "y", F.when(full, div(F.sum("n").over(w), 2 * reach + 1)).otherwise(F.col("n")).alias("n"))


def line_runs(rows: DataFrame, threshold, least: int = 10) -> DataFrame:
    """(page_id, line_idx, y1, y2): runs of rows above the threshold, at least ``least`` high."""
    page = Window.partitionBy("page_id").orderBy("y")
    above = rows.where(F.col("n") > threshold).withColumn("island", F.col("y") - F.row_number().over(page))
    runs = above.groupBy("page_id", "island").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2")).where(F.col("y2") - F.col("y1") >= least)
    order = Window.partitionBy("page_id").orderBy("y1")
    return runs.select("page_id", (F.row_number().over(order) - 1).alias("line_idx"), "y1", "y2")


def line_crops(runs: DataFrame, height) -> DataFrame:
    """Clamped crop rows: top = min(y1, max(h-1, 0)), bottom = max(min(y2, h), top + 1)."""
    h = height
    top = F.least(F.col("y1"), F.greatest(h - 1, F.lit(0)))
    return runs.withColumn("top", top).withColumn("bottom", F.greatest(F.least(F.col("y2"), h), F.col("top") + 1))


def line_pixels(crops: DataFrame, pixels: DataFrame) -> DataFrame:
    """(page_id, line_idx, y, x, gray): the crops' pixels, y from the crop's top; no files."""
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    j = crops.select("page_id", "line_idx", "top", "bottom").join(pixels, "page_id").where(inside)
    return j.select("page_id", "line_idx", (F.col("y") - F.col("top")).alias("y"), "x", "gray")


def luma(r, g, b):
    """(2126 r + 7152 g + 722 b) / 10000 in whole numbers."""
    return div(2126 * r + 7152 * g + 722 * b, 10000)


def planar(pixels: DataFrame, mean: tuple, std: tuple) -> DataFrame:
    """(page_id, at, value) of RGB rows (page_id, y, x, r, g, b): (p / 255 - mean) / std by
    channel, at its place in the channel-first layout."""
    sizes = pixels.groupBy("page_id").agg((F.max("y") + 1).cast("bigint").alias("h"), (F.max("x") + 1).cast("bigint").alias("w"))
    each = [F.struct(F.lit(c).alias("c"), ((F.col(n) / 255.0 - mean[c]) / std[c]).alias("value")) for c, n in enumerate("rgb")]
    e = pixels.select("page_id", "y", "x", F.explode(F.array(*each)).alias("e")).join(sizes, "page_id")
    return e.select("page_id", (F.col("e.c") * F.col("h") * F.col("w") + F.col("y") * F.col("w") + F.col("x")).alias("at"), "e.value")


def segment_lines(pixels: DataFrame, share: float = 0.008) -> DataFrame:
    """Pixels to text lines: threshold, dilate, histogram, smooth, runs."""
    rows = smooth_histogram(foreground_rows(pixels))
    widths = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"))
    least = (F.col("width").cast("float") * F.lit(share).cast("float")).cast("float").cast("bigint")
    return line_runs(rows.join(widths.select("page_id", least.alias("threshold")), "page_id"), F.col("threshold"))
