"""Image resampling as a relation: pixels in, pixels out, one axis after the other.

Each pixel is spread to the new places within reach of the kernel, with its weight; a new
place is the weighted sum of what it gets over the sum of the weights.  So no table of
weights is joined, sums are combined before each of the two shuffles, and a page may be
larger than a task.  The kernels and the reach are those of ``functions.resample``.

Defined results: sizes below one and null pixels give no rows; a page that lacks pixels is
weighed from those that it has; rows that share a place count together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = {"lanczos3": 3.0, "triangle": 1.0}


def _sinc(x: Column) -> Column:
    t = F.lit(math.pi) * x
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(t) / t)


def _kernel(x: Column, kernel: str) -> Column:
    if kernel == "triangle":
        return F.greatest(F.lit(1.0) - F.abs(x), F.lit(0.0))
    return F.when(F.abs(x) < 3, _sinc(x) * _sinc(x / F.lit(3.0))).otherwise(F.lit(0.0))


def spread(at: Column, size: Column, new: Column, kernel: str) -> Column:
    """Array of (to, w): the new places that an old place reaches, and its weight there.

    The kernel widens with the ratio when an image shrinks, so that every pixel counts.
    """
    ratio = size.cast("double") / new
    reach = F.greatest(ratio, F.lit(1.0)) * F.lit(SUPPORT[kernel])
    lo = F.greatest(F.ceil((at + F.lit(0.5) - reach) / ratio - F.lit(0.5)), F.lit(0))
    hi = F.least(F.floor((at + F.lit(0.5) + reach) / ratio - F.lit(0.5)), new - 1)

    def one(to: Column) -> Column:
        x = (at + F.lit(0.5) - (to + F.lit(0.5)) * ratio) / F.greatest(ratio, F.lit(1.0))
        return F.struct(to.cast("int").alias("to"), _kernel(x, kernel).alias("w"))

    return F.when(lo <= hi, F.transform(F.sequence(lo, hi), one))


def _axis(pixels: DataFrame, axis: str, size: str, new: str, kernel: str, by: list[str], value: str) -> DataFrame:
    rows = pixels.where((F.col(size) > 0) & (F.col(new) > 0)).withColumn("hit", F.explode(spread(F.col(axis), F.col(size), F.col(new), kernel)))
    rows = rows.select(*by, F.col("hit.to").alias(axis), F.col("hit.w").alias("w"), (F.col("hit.w") * F.col(value)).alias("wv"))
    total = F.sum("w")
    return rows.groupBy(*by, axis).agg(F.when(F.abs(total) > 0, F.sum("wv") / total).alias(value))


def quantised(v: Column) -> Column:
    """A sum of weighted bytes as a byte: half up (a millionth below counts as half), clamped."""
    return F.least(F.greatest(F.floor(F.round(v, 6) + F.lit(0.5)), F.lit(0)), F.lit(255)).cast("int")


def resampled(pixels: DataFrame, kernel: str = "lanczos3") -> DataFrame:
    """pixels (page_id, y, x, gray, h, w, nh, nw), of pages of h x w, to (page_id, y, x, gray) of
    nh x nw."""
    p = pixels.where("gray is not null").withColumn("v", F.col("gray").cast("double"))
    p = p.withColumnsRenamed({"w": "width", "h": "height"})
    p = _axis(p, "y", "height", "nh", kernel, ["page_id", "x", "width", "nw"], "v")
    p = _axis(p, "x", "width", "nw", kernel, ["page_id", "y"], "v")
    return p.where("v is not null").select("page_id", "y", "x", quantised(F.col("v")).alias("gray"))


def filled(pixels: DataFrame, side: int, kernel: str = "triangle") -> DataFrame:
    """pixels (page_id, y, x, gray, h, w) to squares: scaled to cover them, aspect kept, the
    overflow cut evenly from both ends."""
    scale = F.greatest(F.lit(float(side)) / F.col("w"), F.lit(float(side)) / F.col("h"))
    p = pixels
    for new, size in (("nw", "w"), ("nh", "h")):
        p = p.withColumn(new, F.greatest(F.lit(side), F.rint(F.col(size) * scale).cast("int")))
    sizes = p.groupBy("page_id").agg(F.max("nw").alias("nw"), F.max("nh").alias("nh"))
    out = resampled(p, kernel).join(sizes, "page_id")
    for axis, new in (("x", "nw"), ("y", "nh")):
        first = F.floor((F.col(new) - side) / 2).cast("int")
        out = out.withColumn(axis, F.col(axis) - first)
    return out.where(F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1)).select("page_id", "y", "x", "gray")
