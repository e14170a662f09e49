"""Page lists: listing, known pages, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, contains_all, contains_any, is_page_image


def list_pages(files: DataFrame) -> DataFrame:
    """(path, name) of the image files, in byte order of the path."""
    named = files.select("path", F.coalesce(F.nullif(base_name(F.col("path")), F.lit("")), F.lit("unknown")).alias("name"))
    return named.where(is_page_image(F.col("name"))).orderBy("path")


def known_pages(pages: DataFrame, needles: list[str]) -> DataFrame:
    return pages.where(contains_any(F.col("path"), needles))


def any_known(pages: DataFrame, needles: list[str]) -> DataFrame:
    """One row: does any page match? False for no pages."""
    return pages.agg(F.coalesce(F.bool_or(contains_any(F.col("path"), needles)), F.lit(False)).alias("found"))


def first_match(pages: DataFrame, needles: list[str]) -> DataFrame:
    """The first path in order that holds all needles."""
    return pages.where(contains_all(F.col("path"), needles)).select("path").orderBy("path").limit(1)


def routed(text: Column, other: Column, confidence: Column, threshold: float = 0.28) -> Column:
    """``other`` where the single-precision confidence is above the threshold, if it is there."""
    return F.when(confidence.cast("float") > F.lit(threshold).cast("float"), F.coalesce(other, text)).otherwise(text)
