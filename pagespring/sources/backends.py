"""Model backends behind batch functions, with deterministic stand-ins.

A backend is made once per Python worker by a factory that is shipped to it.  Weights
are not part of this repository; the stand-ins need none and make every step testable.

Defined results: a row whose backend fails, or whose image could not be decoded, keeps
status 'failed' and the error, and costs no other row its result; a caption that fails
leaves the text with the captions before it; null texts have no regions; rows that share a
name are rows of their own, but images of one name are matched by name, so names are to be
unique where pixels are joined; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linework, resample
from ..functions.captions import Failed, Fold, pooled
from ..operators.pages import routed
from ..operators.regions import regions
from ..operators.sizes import padded, resized

#: Pages of unfilled batches that a task holds.
PAGES_HELD = 64
RECOGNISED = "name string, text string, confidence float, img_w bigint, img_h bigint, status string, error string"
LINES = "name string, line_idx int, y1 int, y2 int, height int, width int, pixels binary"


class Recogniser(Protocol):
    def recognise(self, contents: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(text, confidence, width, height) of each page image."""


class Captioner(Protocol):
    """May also have ``captions(prompts, labels)``, which tells those of a batch at once."""

    def caption(self, prompt: str, label: str) -> str: ...


class LineReader(Protocol):
    def read(self, lines: list[bytes]) -> list[str]: ...


class ImageRecogniser(Protocol):
    def recognise(self, pixels: np.ndarray, patches: tuple[int, int]) -> list[tuple[str, float]]:
        """(text, confidence) of each page of a batch (N, 3, H, W) of one size."""


class ImageCaptioner(Protocol):
    """May also have ``captions(prompts, pixels)`` for a batch (N, 3, 378, 378)."""

    def caption(self, prompt: str, pixels: np.ndarray) -> str:
        """The caption of a region's crop (3, 378, 378)."""


class ImageLineReader(Protocol):
    def read(self, pixels: np.ndarray) -> list[str]:
        """The text of each line of a batch (N, 3, 384, 384)."""


def _digest(pixels: np.ndarray) -> str:
    return hashlib.md5(np.ascontiguousarray(pixels, np.float32).tobytes()).hexdigest()[:8]


class StubImageRecogniser:
    def recognise(self, pixels, patches):
        return [(f"page {_digest(p)} of {patches[0]} x {patches[1]}", 0.5) for p in pixels]


class StubImageCaptioner:
    def caption(self, prompt, pixels):
        return f"[figure {_digest(pixels)}]"

    def captions(self, prompts, pixels):
        return [self.caption(t, p) for t, p in zip(prompts, pixels, strict=True)]


class StubImageLineReader:
    def read(self, pixels):
        return [f"line {_digest(p)}" for p in pixels]


class StubRecogniser:
    def recognise(self, contents):
        return [(f"page {hashlib.md5(c).hexdigest()[:8]}", 0.5, 1654, 2339) for c in contents]


class StubCaptioner:
    def caption(self, prompt, label):
        return f"[figure {hashlib.md5((prompt + label).encode()).hexdigest()[:8]}]"

    def captions(self, prompts, labels):
        return [self.caption(t, x) for t, x in zip(prompts, labels, strict=True)]


class StubLineReader:
    def read(self, lines):
        return [f"line {len(x)}" for x in lines]


def _made(factory: Callable, kept: dict):
    if "backend" not in kept:
        kept["backend"] = factory()
    return kept["backend"]


def _each(call: Callable, batch: list) -> list[tuple]:
    """(result, error) of each item: of one call for all, or where that fails one by one."""
    try:
        found = call(batch)
        if len(found) == len(batch):
            return [(r, None) for r in found]
    except Exception:  # the items are tried alone, so that each has its own error
        pass
    out = []
    for item in batch:
        try:
            out.append((call([item])[0], None))
        except Exception as e:  # one item's failure stays that item's
            out.append((None, str(e)))
    return out


def recognise(pages: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """pages (name, content) to (name, text, confidence, img_w, img_h, status, error, regions)."""
    kept: dict = {}

    def run(batches):
        for batch in batches:
            found = _each(lambda c: _made(factory, kept).recognise(c), list(batch["content"]))
            rows = [(n, *r, "ok", None) if e is None else (n, None, None, None, None, "failed", e) for n, (r, e) in zip(batch["name"], found, strict=True)]
            frame = pd.DataFrame(rows, columns=["name", "text", "confidence", "img_w", "img_h", "status", "error"])
            yield frame.astype({"img_w": "Int64", "img_h": "Int64"})

    out = pages.select("name", "content").mapInPandas(run, RECOGNISED)
    return out.withColumn("regions", regions(F.col("text"), F.col("img_w"), F.col("img_h")))


def _rgb(pixels: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(int(h), int(w), 3)


#: Bytes of prepared pages that one range of a size class should hold.
RANGE_BYTES = 512 << 20


def size_classes(images: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """pw, ph (padded width and height), pages, ranges, first (of the ranges of all classes).

    The longer edge is the same for all pages, so there are few classes, whatever the pages.
    """
    width, height = resized(F.col("width"), F.col("height"))
    classes = images.where("status = 'ok'").select(padded(width).alias("pw"), padded(height).alias("ph")).groupBy("pw", "ph").agg(F.count("*").alias("pages"))
    bytes_ = F.col("pages") * F.col("pw") * F.col("ph") * 12  # three planes of single-precision numbers
    ranges = F.ceil(bytes_ / F.lit(range_bytes))
    upto = Window.partitionBy(F.lit(0)).orderBy("pw", "ph").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("ranges", ranges)
    return classes.withColumn("first", F.coalesce(F.sum("ranges").over(upto), F.lit(0)))


def dealt_by_size(images: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """images in partitions that hold a range of one size class each, with pw and ph; a class of
    many pages has many ranges.  Pages that were not decoded are spread over all.  Sizes are
    counted in a pass of their own, so images that are costly to make are better written first."""
    classes = size_classes(images, range_bytes).collect()  # a row for each class
    total = max(1, sum(r["ranges"] for r in classes))
    width, height = resized(F.col("width"), F.col("height"))
    rows = images.withColumn("pw", F.when(F.col("status") == "ok", padded(width))).withColumn("ph", F.when(F.col("status") == "ok", padded(height)))
    at = F.pmod(F.xxhash64("path", "name"), F.lit(total))
    for r in classes:
        own = (F.col("pw") == r["pw"]) & (F.col("ph") == r["ph"])
        at = F.when(own, F.lit(r["first"]) + F.pmod(F.xxhash64("path", "name"), F.lit(r["ranges"]))).otherwise(at)
    return rows.repartitionById(total, at.cast("int"))


def recognise_images(images: DataFrame, factory: Callable[[], ImageRecogniser], batch: int = 8, deal: bool = True, profile=None) -> DataFrame:
    """``files.IMAGES`` to the columns of ``recognise``: pages are resized, padded, normalised
    and stacked with others of their size, ``batch`` to a call.

    With ``deal``, pages are dealt to tasks by their size first, so that of each range of a class
    only the last call can have fewer; without, a task stacks what it reads.  A task holds
    one unfilled batch of a size; of several sizes, PAGES_HELD pages at most.  ``profile`` is
    what the stage's executors and tasks are to have (``decoding.model_profile``), where the
    cluster can schedule by stages.
    """
    kept: dict = {}

    def run(frames):
        waiting: dict[tuple, list] = {}
        for frame in frames:
            done: list[tuple] = []
            for r in frame.itertuples(index=False):
                if r.status != "ok":
                    done.append((r.name, None, None, None, None, "failed", r.error))
                    continue
                x, *grid = resample.recogniser_input(_rgb(r.pixels, r.height, r.width))
                own = waiting.setdefault((x.shape, tuple(grid)), [])
                own.append((r.name, r.width, r.height, x))
                if len(own) == batch:
                    done += read(waiting.pop((x.shape, tuple(grid))), grid)
                elif sum(map(len, waiting.values())) > PAGES_HELD:
                    most = max(waiting, key=lambda k: len(waiting[k]))
                    done += read(waiting.pop(most), most[1])
            if done:
                yield made(done)
        if waiting:
            yield made([row for (_, grid), own in waiting.items() for row in read(own, grid)])

    def read(held, grid):
        found = _each(lambda xs: _made(factory, kept).recognise(np.stack(xs), tuple(grid)), [x for *_, x in held])
        return [(n, None, None, w, h, "failed", e) if e else (n, *got, w, h, "ok", None) for (n, w, h, _), (got, e) in zip(held, found, strict=True)]

    def made(rows):
        out = pd.DataFrame(rows, columns=["name", "text", "confidence", "img_w", "img_h", "status", "error"])
        return out.astype({"img_w": "Int64", "img_h": "Int64"})

    rows = dealt_by_size(images) if deal else images
    out = rows.select("name", "height", "width", "pixels", "status", "error").mapInPandas(run, RECOGNISED, profile=profile)
    return out.withColumn("regions", regions(F.col("text"), F.col("img_w"), F.col("img_h")))


CAPTIONED = "name string, processed_output string, status string, error string"


def _captioner(factory: Callable, kept: dict) -> Callable[[list[tuple]], list[tuple]]:
    """(caption, error) of each (prompt, label or pixels): of one call, if the backend has it."""

    def call(items: list[tuple]) -> list[tuple]:
        try:
            backend = _made(factory, kept)
        except Exception as e:  # no backend: each page keeps its text and the error
            return [(None, str(e))] * len(items)
        if hasattr(backend, "captions"):

            def told(some):
                given = [x for _, x in some]
                return backend.captions([t for t, _ in some], np.stack(given) if isinstance(given[0], np.ndarray) else given)

            return _each(told, items)
        return [_each(lambda some: [backend.caption(*some[0])], [x])[0] for x in items]

    return call


def _folded(pages, call: Callable, batch: int):
    """CAPTIONED frames of pages (name, fold, given), as they get done."""
    rows: list[tuple] = []

    def made():
        return pd.DataFrame(rows, columns=["name", "processed_output", "status", "error"])

    for name, fold in pooled(pages, call, batch):
        rows.append((name, fold.text, "failed" if fold.error is not None else "ok", fold.error))
        if len(rows) >= 1024:
            yield made()
            rows = []
    if rows:
        yield made()


def _captioned(held: DataFrame, run, widened: Callable[[DataFrame], DataFrame] = lambda some: some, profile=None) -> DataFrame:
    """Pages without regions never reach Python."""
    some = F.coalesce(F.size("regions"), F.lit(0)) > 0
    plain = held.where(~some).select("name", F.col("text").alias("processed_output"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return plain.union(widened(held.where(some)).mapInPandas(run, CAPTIONED, profile=profile))


def caption(recognised: DataFrame, factory: Callable[[], Captioner], batch: int = 16, profile=None) -> DataFrame:
    """Splices captions over markers: (name, processed_output, status, error); the backend sees
    a region's prompt and label, ``batch`` regions of any pages and levels at a time."""
    kept: dict = {}

    def run(batches):
        def pages():
            for frame in batches:
                for name, text, found in frame.itertuples(index=False):
                    labels = [r["label"] for r in found]
                    yield name, Fold(text, labels), labels

        yield from _folded(pages(), _captioner(factory, kept), batch)

    return _captioned(recognised.select("name", "text", "regions"), run, profile=profile)


def caption_images(recognised: DataFrame, images: DataFrame, factory: Callable[[], ImageCaptioner], batch: int = 16, profile=None) -> DataFrame:
    """Splices captions over markers: (name, processed_output, status, error); the backend sees
    a region's prompt and the pixels of its crop, ``batch`` regions of any pages and levels at
    a time.

    A region without extent, or outside its page, keeps its marker.  Only pages with regions
    are joined to their pixels; an open page holds its crops, not its image.
    """
    kept: dict = {}

    def run(batches):
        def pages():
            for frame in batches:
                for name, text, found, pixels, h, w in frame.itertuples(index=False):
                    labels = [r["label"] for r in found]
                    if pixels is None:
                        fold = Fold(text, labels)
                        if not fold.done:
                            fold.tell(fold.at, Failed("the page has no pixels"))
                        yield name, fold, labels
                        continue
                    image = _rgb(pixels, h, w)
                    crops = [image[int(r["y1"]) : int(r["y2"]), int(r["x1"]) : int(r["x2"])] for r in found]
                    crops = [resample.captioner_input(c) if c.size else None for c in crops]
                    yield name, Fold(text, labels, [k for k, c in enumerate(crops) if c is None]), crops

        yield from _folded(pages(), _captioner(factory, kept), batch)

    pixels = images.where("status = 'ok'").select("name", "pixels", "height", "width")
    return _captioned(recognised.select("name", "text", "regions"), run, lambda some: some.join(pixels, "name", "left").select("name", "text", "regions", "pixels", "height", "width"), profile)


def line_images(images: DataFrame) -> DataFrame:
    """LINES of page images: a row per text line with its crop's RGB bytes; no spill files.

    A page without lines, or that could not be decoded, gives none.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, h, w, pixels in batch.itertuples(index=False):
                page = _rgb(pixels, h, w)
                for k, (y1, y2) in enumerate(linework.line_spans(resample.gray_of(page))):
                    top, bottom = linework.crop_rows(y1, y2, int(h))
                    rows.append((name, k, y1, y2, bottom - top, int(w), page[top:bottom].tobytes()))
            yield pd.DataFrame(rows, columns=["name", "line_idx", "y1", "y2", "height", "width", "pixels"])

    return images.where("status = 'ok'").select("name", "height", "width", "pixels").mapInPandas(run, LINES)


def read_line_images(lines: DataFrame, factory: Callable[[], ImageLineReader], thick: bool = False, batch: int = 16) -> DataFrame:
    """(name, text, errors) of LINES: crops resized, normalised, stacked and read, ``batch`` of a
    task's lines to a call, then a page's lines joined in order.  A line that cannot be read is
    left out of the text and named in ``errors`` (line_idx, error)."""
    kept: dict = {}

    def run(frames):
        held: list[tuple] = []

        def read():
            found = _each(lambda xs: _made(factory, kept).read(np.stack(xs)), [x for *_, x in held])
            rows = [(n, k, line or "", e) for (n, k, _), (line, e) in zip(held, found, strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=["name", "line_idx", "line", "error"])

        for frame in frames:
            for r in frame.itertuples(index=False):
                held.append((r.name, r.line_idx, resample.line_input(_rgb(r.pixels, r.height, r.width), thick)))
                if len(held) == batch:
                    yield read()
        if held:
            yield read()

    read = lines.select("name", "line_idx", "height", "width", "pixels").mapInPandas(run, "name string, line_idx int, line string, error string")
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("line_idx", "error"))))
    return joined_lines(read, failed.alias("errors"))


def with_handwriting(recognised: DataFrame, images: DataFrame, factory: Callable[[], ImageLineReader], threshold: float = 0.28) -> DataFrame:
    """recognised with the texts of pages above the confidence threshold read again line by line;
    a page without a second text keeps its first.  Only those pages' pixels are joined."""
    again = recognised.where(F.col("confidence") > F.lit(threshold).cast("float")).select("name")
    second = read_line_images(line_images(images.join(again, "name", "left_semi")), factory)
    joined = recognised.join(second.select("name", F.col("text").alias("second text")), "name", "left")
    return joined.withColumn("text", routed(F.col("text"), F.col("second text"), F.col("confidence"), threshold)).select(recognised.columns)


def read_lines(crops: DataFrame, factory: Callable[[], LineReader]) -> DataFrame:
    """crops (name, line_idx, crop) to (name, text): non-empty lines joined in order."""
    kept: dict = {}

    def run(batches):
        for batch in batches:
            yield batch[["name", "line_idx"]].assign(line=_made(factory, kept).read(list(batch["crop"])))

    lines = crops.select("name", "line_idx", "crop").mapInPandas(run, "name string, line_idx int, line string")
    return joined_lines(lines)


def joined_lines(lines: DataFrame, *more: Column) -> DataFrame:
    """(name, text) of rows (name, line_idx, line): trimmed, empty ones left out, in order; ``more``
    are further aggregates of a page's lines."""
    from ..functions.text import unicode_trim

    t = lines.withColumn("line", unicode_trim(F.col("line")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("line_idx", "line"))))
    return t.groupBy("name").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("text"), *more)
