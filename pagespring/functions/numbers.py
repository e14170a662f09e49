"""Single-precision arithmetic and whole-number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def parsed_f32(s: Column) -> Column:
    """The number a text holds, 0 where it holds none (digits of other scripts too)."""
    return F.coalesce(F.try_cast(s, "float") if hasattr(F, "try_cast") else s.try_cast("float"), f32(0))


def to_u32(x: Column, most: int = U32) -> Column:
    """Truncated and saturated to the unsigned 32-bit range; what is above it becomes ``most``."""
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), F.lit(0).cast("bigint")).when(x >= F.lit(4294967296.0), F.lit(most).cast("bigint")).otherwise(x.cast("bigint"))


def to_pixels(v: Column, extent: Column, scale: int = 1000, most: int = U32) -> Column:
    """A coordinate on a 0..scale grid in pixels of ``extent``.

    Division, product and result are each rounded to single precision, as the
    coordinates' definition demands; double precision differs for some inputs.
    """
    return to_u32(f32(f32(f32(v) / f32(scale)) * f32(extent)), most)


def div(a: Column, b) -> Column:
    """Integer quotient, truncated."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)
