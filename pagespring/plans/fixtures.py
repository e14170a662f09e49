"""Stand-ins for recogniser output, built from the test tables.

The expressions below are SQL that Spark and DuckDB read alike, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Markers with a plain form, one that extends it by a digit, one without
# a separator, one beyond the grid, one whose extent is negative.
_X1, _Y1 = "(doc_id * 37 % 900)", "(doc_id * 53 % 900)"


def _marker(k: int, sep: str, *v: str) -> str:
    parts = " || ',' || ".join(f"CAST({x} AS STRING)" for x in v)
    return f"'![image](image_{k}.png){sep}' || {parts}"


M1 = _marker(1, " ", _X1, _Y1, f"({_X1} + 50 + doc_id % 60)", f"({_Y1} + 30 + doc_id % 80)")
M1_LONG = f"{M1} || '5'"
M2 = _marker(2, "", _X1, _Y1, "1200", "1300")
M3 = _marker(3, "  ", "700", "600", "300", "200")
PAGE_TEXT = f"""CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN text WHEN 1 THEN text || ' ' || {M1} WHEN 2 THEN {M1} || ' ' || text || ' ' || {M1_LONG}
 WHEN 3 THEN {M1} || ' ' || text || ' ' || {M1} WHEN 4 THEN {M1_LONG} || ' ' || {M1} || text WHEN 5 THEN text || {M2} || ' x ' || {M3} ELSE '   ' END"""
IMG_W = "CAST(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 1654 WHEN 1 THEN 1700 ELSE 1000 END AS BIGINT)"
IMG_H = "CAST(CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 2339 WHEN 1 THEN 2200 ELSE 3000 END AS BIGINT)"
EXTENSION = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.pdf' WHEN 4 THEN '.txt' ELSE '' END"
PATH = f"'data/images/' || source || '-' || CAST(doc_id AS STRING) || {EXTENSION}"
CONFIDENCE = "CAST((doc_id * 17 % 100) / CAST(100 AS FLOAT) AS FLOAT)"
PAGES_SQL = f"SELECT doc_id, {PAGE_TEXT} AS text, {IMG_W} AS img_w, {IMG_H} AS img_h, {PATH} AS path, {CONFIDENCE} AS confidence FROM documents"
GRAY = "CAST(least(greatest(floor((CAST({v} AS DOUBLE) + 1) * 127.5), 0), 255) AS INT)"
TOKEN = "CAST(CASE event_type WHEN 'purchase' THEN 151645 WHEN 'click' THEN 7 WHEN 'view' THEN 11 ELSE length(event_type) END AS BIGINT)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id", f"{PAGE_TEXT} AS text", f"{IMG_W} AS img_w", f"{IMG_H} AS img_h", f"{PATH} AS path", f"{CONFIDENCE} AS confidence")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, y, x, gray): 50 vectors make an image of 50 rows."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "posexplode(embedding) AS (x, v)")
    return e.selectExpr("CAST(vec_id DIV 50 AS BIGINT) AS page_id", "CAST(vec_id % 50 AS INT) AS y", "x", GRAY.format(v="v") + " AS gray")


PIXELS_SQL = f"""SELECT CAST(vec_id // 50 AS BIGINT) AS page_id, CAST(vec_id % 50 AS INT) AS y, CAST(i AS INT) AS x, {GRAY.format(v="embedding[i + 1]")} AS gray
 FROM embeddings, unnest(range(len(embedding))) AS u(i)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, tokens, confidences) in order of (ts, event_id), by user."""
    e = table(spark, sf_dir, "events").selectExpr("user_id AS page_id", f"struct(ts, event_id, {TOKEN} AS token, coalesce(value, 0D) AS confidence) AS t")
    return e.groupBy("page_id").agg({"t": "collect_list"}).selectExpr("page_id", "array_sort(`collect_list(t)`) AS t").selectExpr("page_id", "t.token AS tokens", "t.confidence AS confidences")


TOKENS_SQL = f"""SELECT user_id AS page_id, list({TOKEN} ORDER BY ts, event_id) AS tokens, list(coalesce(value, 0) ORDER BY ts, event_id) AS confidences FROM events GROUP BY user_id"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, v): embeddings as logits in double precision."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS page_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS v")


VECTORS_SQL = "SELECT vec_id AS page_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
