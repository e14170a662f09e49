"""License scan by MinHash bands over overlapping windows, in DataFrame functions only.

A text is cut into lower-case words of letters and digits and their five-word
shingles.  Templates are classed by length: class c (a power of two) holds those of
c/2 < n <= c shingles and is looked for in windows of c + c/2 shingles that start
every c/2 (one shingle for c = 1), so a whole template always lies inside a window and
its similarity to that window is above 1/3.  With BANDS bands of one coordinate a
window misses its template with probability below (2/3)**BANDS = 2e-6; at the least
containment of 0.8 below (0.76)**BANDS = 2e-4.

A window can only meet a template in a band if it holds the shingle that gives the
template its minimum there.  So signatures are computed just for the windows that hold
one of those shingles; this changes no collision.  Templates retrieved by a band are
verified: the exact share of their shingles that the window contains.

A statement under five words has no shingle of five and is no template (it is refused as
one).  Given as a notice its whole word sequence is its one shingle: it goes through the same
bands with shingles of as many words, in a class for each number of words.

Defined results: null or empty texts match nothing, and texts under five words match
notices only; of several windows the best counts, of equal
ones the first; repeated rows give repeated results counted once per doc_id; a null
doc_id is reported as null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
BANDS = 32
CONTAINED = 0.8
TEMPLATES_MOST = 4096
SHINGLES_MOST = 4_000_000  # of all templates: 32 MB
NOT_WORD = r"[^\p{L}\p{N}]+"

# License statements as they are commonly written.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Fixed value: statements under five words, for ``scan``'s notices.
NOTICES = {"all-rights-reserved": "All rights reserved."}


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def shingle_array(words: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles in order; empty below ``width`` words."""
    n = F.size(words) - (width - 1)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later steps read but the optimizer does not copy into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def minima(shingles: Column) -> Column:
    """The bands: (number, minimum) of each coordinate."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[F.struct(F.lit(k).alias("band"), least(k).alias("least")) for k in range(BANDS)])


def places_of(shingles: Column, signs: list[int]) -> Column:
    """Where one of the signs stands."""
    return F.filter(F.transform(shingles, lambda x, i: F.when(x.isin(signs), i)), lambda i: i.isNotNull())


def windows_around(places: Column, c: int, width: int = SHINGLE) -> Column:
    """The class's windows (width, c, at, size) that hold one of the places."""
    step, size = max(1, c // 2), max(1, c + c // 2)
    first = F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("int"), F.floor(p / step).cast("int")))
    return F.transform(F.array_distinct(F.flatten(first)), lambda j: F.struct(F.lit(width).alias("width"), F.lit(c).alias("c"), (j * step).alias("at"), F.lit(size).alias("size")))


def template_frame(spark, templates: dict[str, str], notices: dict[str, str] | None = None) -> DataFrame:
    """license, width (words of a shingle), c, t (distinct shingles), bands; at most
    TEMPLATES_MOST rows.  A notice's shingles are as wide as it is long."""
    statements = [(k, v, False) for k, v in sorted(templates.items())] + [(k, v, True) for k, v in sorted((notices or {}).items())]
    if len(statements) > TEMPLATES_MOST:
        raise ValueError("too many templates")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text"), F.lit(n).alias("notice")) for k, v, n in statements]))
    t = spark.range(1).select(rows.alias("r")).select("r.*").withColumn("w", word_array(F.col("text")))
    t = t.withColumn("width", F.when(F.col("notice"), F.size("w")).otherwise(SHINGLE))
    s = F.when(F.col("width") == SHINGLE, shingle_array(F.col("w")))
    for width in range(1, SHINGLE):
        s = s.when(F.col("width") == width, shingle_array(F.col("w"), width))
    t = t.withColumn("s", F.when(F.col("notice") & ~F.col("width").between(1, SHINGLE - 1), F.array().cast("array<bigint>")).otherwise(s))
    t = t.withColumn("c", F.pow(2, F.ceil(F.log2(F.size("s")))).cast("int")).withColumn("t", F.array_distinct("s"))
    return t.select("license", "notice", "width", "c", "t", minima(F.col("t")).alias("bands"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_shingle (of the best window)."""
    if set(notices or ()) & set(templates or TEMPLATES):
        raise ValueError("a notice has a template's name")
    known = template_frame(docs.sparkSession, templates or TEMPLATES, notices)
    listed = known.select("notice", "width", "c", "t").collect()  # bounded by TEMPLATES_MOST
    if any(not r["t"] and not r["notice"] for r in listed):
        raise ValueError("a template has fewer than five words")
    if any(not r["t"] for r in listed):
        raise ValueError("a notice has no word or five and more")
    if sum(len(r["t"]) for r in listed) > SHINGLES_MOST:
        raise ValueError("the templates are too long")
    classes = sorted({(r["width"], r["c"]) for r in listed})
    keys = known.select("license", "width", "c", F.explode("bands").alias("b")).select("license", "width", "c", "b.band", "b.least")
    # the shingles that give a template its minimum in some band
    least = F.explode(F.flatten(F.transform("bands", lambda b: F.filter("t", lambda x: F.xxhash64(x, b["band"]) == b["least"]))))
    signs: dict[int, list[int]] = {}
    for width, sign in sorted({tuple(r) for r in known.select("width", least).distinct().collect()}):  # BANDS a template
        signs.setdefault(width, []).append(sign)
    d = docs.select("doc_id", F.explode(F.array(word_array(F.col("text")))).alias("w"))
    for width, own in signs.items():
        d = _once(d, f"h{width}", shingle_array(F.col("w"), width))
        d = _once(d, f"places{width}", places_of(F.col(f"h{width}"), own))
    windows = F.concat(*[windows_around(F.col(f"places{width}"), c, width) for width, c in classes])
    d = d.select("doc_id", *(f"h{width}" for width in signs), F.explode(windows).alias("v"))
    s = F.coalesce(*[F.when(F.col("v.width") == width, F.slice(f"h{width}", F.col("v.at") + 1, F.col("v.size"))) for width in signs])
    d = d.select("doc_id", F.explode(F.array(F.struct("v.width", "v.c", "v.at", s.alias("s")))).alias("v")).select("doc_id", "v.*")
    d = d.select("doc_id", "width", "c", "at", "s", F.explode(minima(F.col("s"))).alias("b")).select("doc_id", "width", "c", "at", "s", "b.*")
    found = d.join(F.broadcast(keys), ["width", "c", "band", "least"])  # BANDS rows a template, TEMPLATES_MOST checked
    found = found.select("doc_id", "license", "at", "s").distinct()  # a window that meets its template in several bands
    found = found.join(F.broadcast(known.select("license", "t")), "license")  # SHINGLES_MOST checked
    share = F.size(F.array_intersect("s", "t")) / F.size("t")
    found = found.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= contained)
    best = found.groupBy("doc_id", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("before"))).alias("x"))
    return best.select("doc_id", "license", "x.containment", (-F.col("x.before")).cast("long").alias("first_shingle"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), notices=NOTICES)


def _listed(statements: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(statements.items()))


OP3_SQL = f"""
WITH tw AS (
  SELECT license, list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM (VALUES {_listed(TEMPLATES)}) AS v(license, text)
), t AS (
  SELECT license, list_distinct(list_transform(range(len(w) - 4), lambda i: list_slice(w, i + 1, i + 5))) AS t,
    CAST(pow(2, ceil(log2(len(w) - 4))) AS BIGINT) AS c FROM tw
), dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, list_transform(range(greatest(len(w) - 4, 0)), lambda i: list_slice(w, i + 1, i + 5)) AS h FROM dw
), hit AS (  -- only texts that hold a shingle of a template can contain it
  SELECT DISTINCT d.doc_id, t.license FROM (SELECT doc_id, unnest(h) AS x FROM d) d JOIN (SELECT license, unnest(t) AS x FROM t) t ON d.x = t.x
), v AS (
  SELECT d.doc_id, t.license, t.t, j * greatest(1, t.c // 2) AS pos,
    list_slice(d.h, j * greatest(1, t.c // 2) + 1, j * greatest(1, t.c // 2) + greatest(1, t.c + t.c // 2)) AS s
  FROM hit JOIN d ON d.doc_id = hit.doc_id JOIN t ON t.license = hit.license, unnest(range(CAST(len(d.h) // greatest(1, t.c // 2) + 1 AS BIGINT))) AS u(j)
), nw AS (
  SELECT license, list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda x: x <> '') AS w FROM (VALUES {_listed(NOTICES)}) AS v(license, text)
), nr AS (
  SELECT doc_id, license, list_min(list_filter(range(len(dw.w) - len(nw.w) + 1), lambda i: list_slice(dw.w, i + 1, i + len(nw.w)) = nw.w)) AS pos FROM dw, nw
), r AS (
  SELECT doc_id, license, pos, CAST(len(list_intersect(list_distinct(s), t)) AS DOUBLE) / len(t) AS containment FROM v
)
SELECT doc_id, license, containment, CAST(min(pos) AS BIGINT) AS first_shingle FROM (
  SELECT *, max(containment) OVER (PARTITION BY doc_id, license) AS best FROM r
) WHERE containment = best AND containment >= {CONTAINED} GROUP BY doc_id, license, containment
UNION ALL SELECT doc_id, license, 1.0::DOUBLE, CAST(min(pos) AS BIGINT) FROM nr WHERE pos IS NOT NULL GROUP BY doc_id, license
"""
