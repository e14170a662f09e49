"""Queries over pixels and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.resample import MEAN, STD
from ..operators import raster as rs
from ..operators import resampling as rz
from ..operators import sizes as sz
from ..sources.backends import joined_lines, size_classes
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _box(agg: str, c: str, r: int, by: str, order: str) -> str:
    return f"{agg}({c}) OVER (PARTITION BY page_id, {by} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


_P = f"p AS ({fx.PIXELS_SQL})"
_T = (
    f"{_P}, t1 AS (SELECT *, {_box('sum', 'gray', 20, 'y', 'x')} AS s, {_box('count', '*', 20, 'y', 'x')} AS c FROM p),"
    f" t2 AS (SELECT page_id, y, x, gray, {_box('sum', 's', 20, 'x', 'y')} AS s, {_box('sum', 'c', 20, 'x', 'y')} AS c FROM t1),"
    " t AS (SELECT page_id, y, x, CAST(CASE WHEN gray < (s // c) - 5 THEN 255 ELSE 0 END AS INT) AS value FROM t2)"
)
_D = (
    f"{_T}, d1 AS (SELECT *, {_box('max', 'value', 1, 'y', 'x')} AS m FROM t), d2 AS (SELECT page_id, y, x, {_box('max', 'm', 1, 'x', 'y')} AS m FROM d1),"
    " d AS (SELECT page_id, y, x, CAST(CASE WHEN m > 0 THEN 255 ELSE 0 END AS INT) AS value FROM d2)"
)
_H = f"{_D}, h AS (SELECT page_id, y, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM d GROUP BY page_id, y)"
_S = (
    f"{_H}, s1 AS (SELECT *, count(*) OVER w AS c, sum(n) OVER w AS s FROM h WINDOW w AS (PARTITION BY page_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),"
    " s AS (SELECT page_id, y, CAST(CASE WHEN c = 7 THEN s // 7 ELSE n END AS BIGINT) AS n FROM s1)"
)
#: Rows above this many pixels form lines in the run queries.
_ABOVE = 20
_R = (
    f"{_S}, r1 AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM s WHERE n > {_ABOVE}),"
    " r AS (SELECT page_id, CAST(min(y) AS INT) AS y1, CAST(max(y) + 1 AS INT) AS y2 FROM r1 GROUP BY page_id, island HAVING max(y) + 1 - min(y) >= 3)"
)


@_query(f"WITH {_T} SELECT * FROM t")
def adaptive_threshold(spark, sf):
    return rs.adaptive_threshold(fx.pixels(spark, sf))


@_query(f"WITH {_D} SELECT * FROM d")
def dilate(spark, sf):
    return rs.dilate(rs.adaptive_threshold(fx.pixels(spark, sf)))


@_query(f"WITH {_P}, a AS (SELECT *, {_box('min', 'gray', 1, 'y', 'x')} AS m FROM p), b AS (SELECT page_id, y, x, gray, {_box('min', 'm', 1, 'x', 'y')} AS m FROM a) SELECT page_id, y, x, CAST(CASE WHEN m < 60 THEN 0 ELSE gray END AS INT) AS gray FROM b")
def thicken(spark, sf):
    return rs.thicken(fx.pixels(spark, sf), ink=60)


@_query(f"WITH {_H} SELECT * FROM h")
def row_histogram(spark, sf):
    return rs.row_histogram(rs.dilate(rs.adaptive_threshold(fx.pixels(spark, sf))))


def _smoothed(spark, sf):
    return rs.smooth_histogram(row_histogram(spark, sf))


@_query(f"WITH {_S} SELECT * FROM s")
def smooth_histogram(spark, sf):
    return _smoothed(spark, sf)


@_query(f"WITH {_R} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1) - 1 AS INT) AS line_idx, y1, y2 FROM r")
def line_runs(spark, sf):
    return rs.line_runs(_smoothed(spark, sf), F.lit(_ABOVE), least=3)


@_query(f"WITH {_R} SELECT page_id, y1, y2, least(y1, 39) AS top, greatest(least(y2, 40), least(y1, 39) + 1) AS bottom FROM r")
def line_crop_bounds(spark, sf):
    return rs.line_crops(rs.line_runs(_smoothed(spark, sf), F.lit(_ABOVE), least=3), F.lit(40)).drop("line_idx")


_CROPS = (
    f"{_R}, c AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1) - 1 AS INT) AS line_idx, least(y1, 49) AS top, greatest(least(y2, 50), least(y1, 49) + 1) AS bottom FROM r),"
    " x AS (SELECT c.page_id, c.line_idx, CAST(p.y - c.top AS INT) AS y, p.x, p.gray FROM c JOIN p ON p.page_id = c.page_id AND p.y >= c.top AND p.y < c.bottom)"
)


def _crops(spark, sf):
    runs = rs.line_runs(_smoothed(spark, sf), F.lit(_ABOVE), least=3)
    return rs.line_pixels(rs.line_crops(runs, F.lit(50)), fx.pixels(spark, sf))


@_query(f"WITH {_CROPS} SELECT * FROM x")
def line_crop_pixels(spark, sf):
    return _crops(spark, sf)


@_query(f"WITH {_CROPS}, e AS (SELECT page_id, line_idx, 'line ' || CAST(sum(gray * (x + 1)) AS VARCHAR) || ' ' AS line FROM x GROUP BY page_id, line_idx) SELECT page_id, string_agg(trim(line), chr(10) ORDER BY line_idx) AS text FROM e GROUP BY page_id")
def page_transcription(spark, sf):
    """Pages to lines to text, with a stand-in for the reader that depends on every pixel."""
    read = _crops(spark, sf).groupBy(F.col("page_id").alias("name"), "line_idx").agg(F.sum(F.col("gray") * (F.col("x") + 1)).alias("s"))
    lines = read.select("name", "line_idx", F.concat(F.lit("line "), F.col("s").cast("string"), F.lit(" ")).alias("line"))
    return joined_lines(lines).withColumnRenamed("name", "page_id")


_RGB = f"{_P}, c AS (SELECT page_id, y, x, gray AS r, gray * 3 % 256 AS g, gray * 7 % 256 AS b FROM p)"


def _rgb(spark, sf):
    return fx.pixels(spark, sf).selectExpr("page_id", "y", "x", "gray AS r", "gray * 3 % 256 AS g", "gray * 7 % 256 AS b")


@_query(f"WITH {_RGB} SELECT page_id, y, x, CAST((2126 * r + 7152 * g + 722 * b) // 10000 AS BIGINT) AS gray FROM c")
def gray_luma(spark, sf):
    return _rgb(spark, sf).select("page_id", "y", "x", rs.luma(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


@_query(
    f"WITH {_RGB}, s AS (SELECT page_id, max(y) + 1 AS h, max(x) + 1 AS w FROM c GROUP BY page_id),"
    " e AS (SELECT page_id, y, x, 0 AS c, r AS v FROM c UNION ALL SELECT page_id, y, x, 1, g FROM c UNION ALL SELECT page_id, y, x, 2, b FROM c)"
    f" SELECT e.page_id, CAST(c * h * w + y * w + x AS BIGINT) AS at, round((v / 255.0::DOUBLE - CASE c WHEN 0 THEN {MEAN[0]}::DOUBLE WHEN 1 THEN {MEAN[1]}::DOUBLE ELSE {MEAN[2]}::DOUBLE END)"
    f" / CASE c WHEN 0 THEN {STD[0]}::DOUBLE WHEN 1 THEN {STD[1]}::DOUBLE ELSE {STD[2]}::DOUBLE END, 6) AS value FROM e JOIN s ON s.page_id = e.page_id"
)
def planar_pixels(spark, sf):
    return rs.planar(_rgb(spark, sf), MEAN, STD).withColumn("value", F.round("value", 6))


_LINES = (
    f"{_S}, w AS (SELECT page_id, CAST(trunc(CAST(max(x) + 1 AS FLOAT) * CAST(0.008 AS FLOAT)) AS BIGINT) AS thr FROM p GROUP BY page_id),"
    " l1 AS (SELECT s.page_id, y, y - row_number() OVER (PARTITION BY s.page_id ORDER BY y) AS island FROM s JOIN w ON w.page_id = s.page_id WHERE n > thr),"
    " l AS (SELECT page_id, CAST(min(y) AS INT) AS y1, CAST(max(y) + 1 AS INT) AS y2 FROM l1 GROUP BY page_id, island HAVING max(y) + 1 - min(y) >= 10)"
)


@_query(f"WITH {_LINES} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1) - 1 AS INT) AS line_idx, y1, y2 FROM l")
def segment_lines(spark, sf):
    return rs.segment_lines(fx.pixels(spark, sf))


_SIZES = "d AS (SELECT doc_id, 1 + n_chars % 5000 AS w, 1 + n_chars * 7 % 3000 AS h FROM documents)"
_SCALED = (
    f"{_SIZES}, z AS (SELECT *, CAST(1540 AS FLOAT) / CAST(greatest(w, h) AS FLOAT) AS k FROM d),"
    " r AS (SELECT doc_id, w, h, CAST(round(CAST(CAST(w AS FLOAT) * k AS DOUBLE)) AS BIGINT) AS rw, CAST(round(CAST(CAST(h AS FLOAT) * k AS DOUBLE)) AS BIGINT) AS rh FROM z)"
)


def _sizes(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.selectExpr("doc_id", "1 + n_chars % 5000 AS w", "1 + n_chars * 7 % 3000 AS h")


@_query(f"WITH {_SCALED} SELECT doc_id, rw, rh FROM r")
def resize_dims(spark, sf):
    rw, rh = sz.resized(F.col("w"), F.col("h"))
    return _sizes(spark, sf).select("doc_id", rw.alias("rw"), rh.alias("rh"))


@_query(
    f"WITH {_SCALED}, q AS (SELECT doc_id, (rw + 27) // 28 * 28 AS pw, (rh + 27) // 28 * 28 AS ph FROM r)"
    " SELECT doc_id, pw, ph, pw // 14 AS across, ph // 14 AS down, (pw // 14 // 2) * (ph // 14 // 2) AS tokens FROM q"
)
def pad_patch_grid(spark, sf):
    rw, rh = sz.resized(F.col("w"), F.col("h"))
    q = _sizes(spark, sf).select("doc_id", sz.padded(rw).alias("pw"), sz.padded(rh).alias("ph"))
    across, down, tokens = sz.patch_grid(F.col("pw"), F.col("ph"))
    return q.select("doc_id", "pw", "ph", across.alias("across"), down.alias("down"), tokens.alias("tokens"))


@_query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1) * 127.5), 0), 255) AS INT)) AS g FROM embeddings) SELECT vec_id, list_transform(g, lambda p: round((p / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE, 6)) AS px FROM v")
def pixel_normalize(spark, sf):
    e = fx.table(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, x -> " + fx.GRAY.format(v="x") + ") AS g")
    return e.select("vec_id", F.transform(sz.normalised(F.col("g")), lambda x: F.round(x, 6)).alias("px"))


@_query(
    f"WITH {_SCALED}, q AS (SELECT doc_id, (rw + 27) // 28 * 28 AS pw, (rh + 27) // 28 * 28 AS ph FROM r), c AS (SELECT pw, ph, count(*) AS pages FROM q GROUP BY pw, ph),"
    f" g AS (SELECT *, CAST(ceil(pages * pw * ph * 12 / CAST({1 << 29} AS DOUBLE)) AS BIGINT) AS ranges FROM c) SELECT pw, ph, pages, ranges, CAST(sum(ranges) OVER (ORDER BY pw, ph) - ranges AS BIGINT) AS first FROM g"
)
def page_size_classes(spark, sf):
    """Pages by the size they are padded to, and the ranges of bounded bytes that each size is dealt to."""
    pages = _sizes(spark, sf).selectExpr("w AS width", "h AS height", "'ok' AS status")
    return size_classes(pages, 1 << 29)


def _sql_axis(rows: str, axis: str, size: str, new: str, kernel: str, by: str) -> str:
    """SQL: rows (by, axis, v) resampled along an axis."""
    ratio = f"(CAST({size} AS DOUBLE) / {new})"
    wide = f"greatest({ratio}, 1.0::DOUBLE)"
    reach = f"{wide} * {rz.SUPPORT[kernel]}::DOUBLE"
    x = f"(({axis} + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {ratio}) / {wide})"
    sinc = "CASE WHEN {t} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {t}) / (pi() * {t}) END"
    w = "greatest(1.0::DOUBLE - abs(t), 0.0::DOUBLE)" if kernel == "triangle" else f"CASE WHEN abs(t) < 3 THEN ({sinc.format(t='t')}) * ({sinc.format(t='(t / 3.0::DOUBLE)')}) ELSE 0.0::DOUBLE END"
    lo = f"greatest(CAST(ceil(({axis} + 0.5::DOUBLE - {reach}) / {ratio} - 0.5::DOUBLE) AS BIGINT), 0)"
    hi = f"least(CAST(floor(({axis} + 0.5::DOUBLE + {reach}) / {ratio} - 0.5::DOUBLE) AS BIGINT), {new} - 1)"
    return (
        f"SELECT {by}, CAST(o AS INT) AS {axis}, sum(w * v) / sum(w) AS v FROM (SELECT *, {w} AS w FROM (SELECT {by}, v, o, {x} AS t FROM {rows}, unnest(range({lo}, {hi} + 1)) AS u(o))) GROUP BY {by}, o"
    )


def _sql_resampled(w: int, h: int, nw: int, nh: int, kernel: str) -> str:
    down = _sql_axis("(SELECT page_id, y, x, CAST(gray AS DOUBLE) AS v FROM p)", "y", str(h), str(nh), kernel, "page_id, x")
    across = _sql_axis("a", "x", str(w), str(nw), kernel, "page_id, y")
    return f"{_P}, a AS ({down}), b AS ({across}), r AS (SELECT page_id, y, x, CAST(least(greatest(floor(round(v, 6) + 0.5::DOUBLE), 0), 255) AS INT) AS gray FROM b)"


def _sized(spark, sf):
    return fx.pixels(spark, sf).selectExpr("page_id", "y", "x", "gray", "50 AS h", "64 AS w")


@_query(f"WITH {_sql_resampled(64, 50, 100, 78, 'lanczos3')} SELECT * FROM r")
def resample_longest(spark, sf):
    """Images scaled up so that the longer edge is 100, by the recogniser's kernel."""
    nw, nh = sz.resized(F.col("w"), F.col("h"), 100)
    return rz.resampled(_sized(spark, sf).withColumn("nw", nw.cast("int")).withColumn("nh", nh.cast("int")))


@_query(f"WITH {_sql_resampled(64, 50, 31, 24, 'triangle')} SELECT page_id, y, x - 3 AS x, gray FROM r WHERE x BETWEEN 3 AND 26")
def resample_fill(spark, sf):
    """Images scaled down to cover a square of 24, cut evenly, by the captioner's kernel."""
    return rz.filled(_sized(spark, sf), 24)


@_query(f"WITH {_sql_resampled(64, 50, 40, 40, 'triangle')} SELECT * FROM r")
def resample_square(spark, sf):
    """Images as exact squares, aspect not kept, as the line reader takes them."""
    return rz.resampled(_sized(spark, sf).selectExpr("*", "40 AS nh", "40 AS nw"), "triangle")
