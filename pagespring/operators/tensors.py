"""Relational forms of the models' array steps; real inference stays in a backend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import div
from ..functions.vectors import added, dot, gelu, linear, rms_norm, rotated, swiglu


def splice_positions(tokens: DataFrame, images: DataFrame, image_token: int) -> DataFrame:
    """The k-th image placeholder of a page takes the page's k-th image vector.

    tokens (page_id, pos, token, emb), images (page_id, k from 0, image_emb); fails if
    a page's counts differ.
    """
    w = Window.partitionBy("page_id").orderBy("pos")
    is_image = F.col("token") == image_token
    k = F.when(is_image, F.sum(is_image.cast("bigint")).over(w) - 1)
    t = tokens.withColumn("k", k).withColumn("wanted", F.sum(is_image.cast("bigint")).over(Window.partitionBy("page_id")))
    counts = images.groupBy("page_id").agg(F.count("*").alias("held"))
    j = t.join(images, ["page_id", "k"], "left").join(counts, "page_id", "left")
    agreed = F.when(F.col("wanted") == F.coalesce("held", F.lit(0)), F.coalesce("image_emb", "emb")).otherwise(F.raise_error(F.lit("image token and vector counts differ")))
    return j.select("page_id", "pos", "token", agreed.alias("emb"))


def causal_mask(shapes: DataFrame, sliding: int | None = None) -> DataFrame:
    """(.., i, j, masked) for shapes (.., tgt, offset): position i sees j <= i + offset."""
    held = [c for c in shapes.columns if c not in ("tgt", "offset", "i", "j", "masked")]
    m = shapes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tgt") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tgt") + F.col("offset") - 1)))
    sees = F.col("j") <= F.col("i") + F.col("offset")
    if sliding is not None:
        sees = sees & (F.col("i") + F.col("offset") - F.col("j") <= sliding)
    return m.select(*held, "i", "j", (~sees).alias("masked"))


def attention(rows: DataFrame) -> DataFrame:
    """Causal attention of rows (page_id, pos, q, k, v) within a page: (page_id, pos, out)."""
    keys = rows.select("page_id", F.col("pos").alias("other"), "k", "v")
    s = rows.select("page_id", "pos", "q").join(keys, "page_id").where("other <= pos")
    s = s.withColumn("score", dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double")))
    w = Window.partitionBy("page_id", "pos")
    s = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    s = s.withColumn("p", F.col("e") / F.sum("e").over(w))
    parts = s.select("page_id", "pos", "p", F.posexplode("v").alias("d", "x"))
    out = parts.groupBy("page_id", "pos", "d").agg(F.sum(F.col("p") * F.col("x")).alias("y"))
    return out.groupBy("page_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "y"))), lambda r: r["y"]).alias("out"))


def repeat_heads(heads: DataFrame, n: int) -> DataFrame:
    """Each head n times in a row: head' = head * n + r."""
    r = heads.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return r.withColumn("head", F.col("head") * n + F.col("r")).drop("r")


def patch_merge(patches: DataFrame) -> DataFrame:
    """(page_id, py, px, v) on an even grid to (page_id, py, px, merged): 2 x 2 patches in one.

    Elements go by hidden place first, then by (dy, dx).
    """
    e = patches.select("page_id", "py", "px", F.posexplode("v").alias("h", "x"))
    slot = F.col("h") * 4 + F.col("py") % 2 * 2 + F.col("px") % 2
    g = e.groupBy("page_id", div(F.col("py"), 2).alias("py"), div(F.col("px"), 2).alias("px"))
    return g.agg(F.transform(F.array_sort(F.collect_list(F.struct(slot.alias("s"), "x"))), lambda r: r["x"]).alias("merged"))


def rope_table(positions: DataFrame, dim: int, theta: float = 1_000_000.0) -> DataFrame:
    """(pos, i, cos, sin) of rotary position embedding, i = 0, 2, .. below dim."""
    t = positions.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(dim - 2), F.lit(2))))
    angle = F.col("pos") / F.pow(F.lit(theta), F.col("i") / F.lit(float(dim)))
    return t.select("pos", "i", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def matmul(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, j, y) for rows (id, i, x) and weights (i, j, w): the relational product, combined
    before its shuffle; rows of zeros need no entries."""
    return rows.join(weights, "i").groupBy("id", "j").agg(F.sum(F.col("x") * F.col("w")).alias("y"))


def rotate(rows: DataFrame, table: DataFrame, columns: tuple[str, ...] = ("q", "k"), offset: int = 0) -> DataFrame:
    """rows (.., pos, vectors) turned by their position plus ``offset``; table: ``rope_table``."""
    t = table.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("i", "cos", "sin"))).alias("turn"))
    j = rows.withColumn("turned at", F.col("pos") + offset).join(t.withColumnRenamed("pos", "turned at"), "turned at")
    return j.withColumns({c: rotated(F.col(c), F.col("turn.cos"), F.col("turn.sin")) for c in columns}).select(rows.columns)


def decoder_layer(rows: DataFrame, weights: dict) -> DataFrame:
    """(page_id, pos, x) after one pre-norm layer: x + o(attention(norm x)), then + mlp(norm).

    weights: matrices q, k, v, o, gate, up, down as array columns, and rope as a table or
    None.  One page's positions meet; pages are independent.
    """
    n = rows.withColumn("n", rms_norm(F.col("x")))
    heads = n.select("page_id", "pos", *(linear(F.col("n"), weights[c]).alias(c) for c in ("q", "k", "v")))
    if weights.get("rope") is not None:
        heads = rotate(heads, weights["rope"])
    mixed = rows.join(attention(heads), ["page_id", "pos"])
    h = mixed.select("page_id", "pos", added(F.col("x"), linear(F.col("out"), weights["o"])).alias("h"))
    h = h.withColumn("n", rms_norm(F.col("h")))
    return h.select("page_id", "pos", added(F.col("h"), swiglu(F.col("n"), weights["gate"], weights["up"], weights["down"])).alias("x"))


def projector(patches: DataFrame, merge, first, second) -> DataFrame:
    """(page_id, py, px, out): norm, 2 x 2 patches in one, linear, linear, GELU, linear."""
    folded = patch_merge(patches.withColumn("v", rms_norm(F.col("v"))))
    y = folded.withColumn("y", linear(F.col("merged"), merge))
    y = y.withColumn("y", gelu(linear(F.col("y"), first)))
    return y.select("page_id", "py", "px", linear(F.col("y"), second).alias("out"))


def stacked(images: DataFrame, size: int) -> DataFrame:
    """(batch, ids, n, data): images (id, pos, data) laid end to end, ``size`` to a batch."""
    g = images.groupBy(div(F.col("pos"), size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "data"))).alias("held"))
    return g.select("batch", F.col("held.id").alias("ids"), F.size("held").alias("n"), F.flatten(F.col("held.data")).alias("data"))
