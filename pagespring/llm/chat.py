"""Chat formatting by prefix-target expansion, in DataFrame functions only.

One turn is rendered as ``[INST]role[/INST]text</s>``.  Every assistant turn
becomes an example of its own: all turns before it are context, and only its
text is under the loss mask.  The example's formatted text is the prefix of the
conversation's rendering that ends with that turn, so a conversation is rendered
once and an example is a span over it; ``example_texts`` writes the prefixes out.

Control strings inside a role or text are escaped with ``&lt;`` and ``&#91;``
(an ``&`` that already starts one of the three entities becomes ``&amp;``), which
``unescape`` undoes exactly.

Defined results: a null role or text counts as empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order; a null
conv_id is a conversation of its own; a conversation without assistant turns has
no example; an empty table gives no rows; further columns are ignored.  A
conversation's text meets in one row (its digest and its rendering are sequential);
its size is bounded by Spark's 2 GB a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "[INST]", "[/INST]", "</s>"
# The entities first, then the template's control strings.
ENTITIES = ("&amp;", "&lt;", "&#91;")
CONTROLS = (("</s>", "&lt;/s>"), ("<s>", "&lt;s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))


def escape(c: Column) -> Column:
    for e in ENTITIES:
        c = F.replace(c, F.lit(e), F.lit("&amp;" + e[1:]))
    for plain, safe in CONTROLS:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def render(turns: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, rendering, examples.

    examples: array of (turn, context_chars, loss_start, loss_end, n_chars), offsets
    in code points of the rendering; ``n_chars`` is the length of the example's text.
    """
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP)))
    t = t.withColumn("piece", F.concat("head", escape(F.col("text")), F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = t.withColumn("pos", F.row_number().over(order) - 1)
    # the default frame takes ties together; rows keep them apart
    rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("end", F.sum(F.length("piece").cast("long")).over(rows))
    start = F.col("end") - F.length("piece")
    example = F.struct(
        F.col("pos").alias("turn"),
        start.alias("context_chars"),
        (start + F.length("head")).alias("loss_start"),
        (F.col("end") - len(CLOSE)).alias("loss_end"),
        F.col("end").alias("n_chars"),
    )
    t = t.select("conv_id", F.struct("pos", "piece").alias("p"), F.when(F.col("role") == "assistant", example).alias("e"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("e")).alias("examples"))
    return g.select("conv_id", F.array_join(F.col("p.piece"), "").alias("rendering"), "examples")


def example_texts(rendered: DataFrame, outer: bool = False) -> DataFrame:
    """The examples written out for training: conv_id, example, text, loss_start, loss_end.

    Other columns of ``rendered`` are carried along; with ``outer`` a conversation without
    examples gives a row of nulls.  The method's own cost: a conversation of n turns has
    prefixes of n * n / 4 turns in all.
    """
    kept = [c for c in rendered.columns if c not in ("rendering", "examples")]
    each = F.posexplode_outer if outer else F.posexplode
    return rendered.select(*kept, "rendering", each("examples").alias("example", "e")).select(
        *kept,
        "example",
        F.substring("rendering", F.lit(1), F.col("e.n_chars").cast("int")).alias("text"),
        "e.loss_start",
        "e.loss_end",
    )


def read_turns(rendering: Column) -> Column:
    """Array of (role, text) parsed back from a rendering."""
    pieces = F.split(rendering, CLOSE, -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, SEP, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def digest(turns: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the rendering and the examples."""
    r = render(turns).withColumn("back", read_turns(F.col("rendering")))
    r = r.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        "rendering",
        "examples",
    )
    reply = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    e = example_texts(r, outer=True).withColumn("loss", unescape(F.coalesce(reply, F.lit(""))))
    g = e.groupBy("conv_id", "n_turns", "turns_sha256").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"),
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("formatted_chars"),
    )
    g = g.withColumn("loss", F.array_join(F.col("parts.loss"), ""))
    return g.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe_turns(spark) -> DataFrame:
    """Conversation -1: a user and an assistant row whose texts hold control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and the probe; turns that the table has as conversation -1 join it."""
    from .common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(turns.unionByName(probe_turns(spark)))


def _sql_escaped(c: str) -> str:
    for e in ENTITIES:
        c = f"replace({c}, '{e}', '&amp;{e[1:]}')"
    for plain, safe in CONTROLS:
        c = f"replace({c}, '{plain}', '{safe}')"
    return c


OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len(OPEN + SEP + CLOSE)} AS n FROM t
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM p
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss,
    coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) AS formatted_chars FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
