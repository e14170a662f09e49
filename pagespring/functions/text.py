"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")


def unicode_trim(c: Column) -> Column:
    """Without leading and trailing white space of any script (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case extension; empty for names that only start with a dot, or without one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def is_page_image(name: Column) -> Column:
    return extension(name).isin(*IMAGE_EXTENSIONS)


def contains_any(c: Column, needles: list[str]) -> Column:
    """Does the lower-cased text contain one of the (lower-case) needles?"""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(F.lower(c), F.lit(n))
    return found


def contains_all(c: Column, needles: list[str]) -> Column:
    found = F.lit(True)
    for n in needles:
        found = found & F.contains(F.lower(c), F.lit(n))
    return found
