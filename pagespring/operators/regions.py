"""Image markers in recognised text: extraction, geometry, captions, splicing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import U32, parsed_f32, to_pixels
from ..functions.prompts import AFTER, BARE, BEFORE, CONTEXT_CHARS
from ..functions.text import is_blank, unicode_trim

# Fixed value: the marker's form; (?U) takes digits and white space of any script.
MARKER = r"!\[image\]\(image_(\d+)\.png\)\s*(\d+),(\d+),(\d+),(\d+)"
_UNICODE = "(?U)" + MARKER


def labels(text: Column) -> Column:
    """All markers of a text in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(_UNICODE), F.lit(0))


def regions(text: Column, img_w: Column, img_h: Column, most: int = U32) -> Column:
    """Array of (label, x1, x2, y1, y2) in pixels; those above 32 bits become ``most``."""

    def one(label: Column) -> Column:
        x1, y1, x2, y2 = (parsed_f32(F.regexp_extract(label, _UNICODE, g)) for g in (2, 3, 4, 5))
        return F.struct(
            label.alias("label"),
            to_pixels(x1, img_w, most=most).alias("x1"),
            to_pixels(x2, img_w, most=most).alias("x2"),
            to_pixels(y1, img_h, most=most).alias("y1"),
            to_pixels(y2, img_h, most=most).alias("y2"),
        )

    return F.transform(labels(text), one)


def crop_rectangle(r: Column, img_w: Column, img_h: Column, wrap: bool = False) -> Column:
    """(x, y, w, h, valid) of a region's crop.

    A region without extent, or that starts outside, is not valid and has w = h = 0;
    ``wrap`` instead takes differences in unsigned 32-bit arithmetic.
    """
    valid = (r["x2"] > r["x1"]) & (r["y2"] > r["y1"]) & (r["x1"] < img_w) & (r["y1"] < img_h)
    if wrap:
        m = F.lit(4294967296)
        w = F.least(F.pmod(r["x2"] - r["x1"], m), F.pmod(img_w - r["x1"], m))
        h = F.least(F.pmod(r["y2"] - r["y1"], m), F.pmod(img_h - r["y1"], m))
    else:
        w = F.when(valid, F.least(r["x2"] - r["x1"], img_w - r["x1"])).otherwise(F.lit(0))
        h = F.when(valid, F.least(r["y2"] - r["y1"], img_h - r["y1"])).otherwise(F.lit(0))
    return F.struct(r["x1"].alias("x"), r["y1"].alias("y"), w.cast("bigint").alias("w"), h.cast("bigint").alias("h"), valid.alias("valid"))


def caption_prompt(context: Column) -> Column:
    """Prompt of the captioner: with the page's first characters if there are any."""
    told = F.concat(F.lit(BEFORE), F.left(context, F.lit(CONTEXT_CHARS)), F.lit(AFTER))
    return F.when(is_blank(context), F.lit(BARE)).otherwise(told)


def splice(text: Column, found: Column, caption: Callable[[Column, Column], Column]) -> Column:
    """Folds captions into the text: each label in order is replaced, everywhere it stands.

    ``caption(text so far, label)`` is a column; later captions see earlier ones.  The
    replacement is literal, so a marker that begins another is replaced inside it too.
    """
    return F.aggregate(found, text, lambda acc, label: F.replace(acc, label, caption(acc, label)))


def hash_caption(acc: Column, label: Column) -> Column:
    """A deterministic stand-in for a captioning model, by its prompt and region."""
    return F.concat(F.lit("[figure "), F.substring(F.md5(F.concat(caption_prompt(acc), label)), 1, 8), F.lit("]"))


def merged_placeholders(text: Column, found: Column) -> Column:
    """Trimmed text, with the labels that it lacks appended on lines of their own."""
    return F.aggregate(
        found,
        unicode_trim(text),
        lambda acc, label: F.when(F.contains(acc, label), acc).when(acc == "", label).otherwise(F.concat(acc, F.lit("\n"), label)),
    )
