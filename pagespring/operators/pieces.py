"""Byte tokens to text, piece by piece: what each token of a stream completes.

A token may end inside a character.  Its piece is the characters that it completes, the first
bytes of the next one wait for the next token.  Which bytes wait is told by the last three
before a place, so the pieces are a map over the tokens in order: no state is carried from
the first token to the last, and a sequence may be of any length.

Defined results: null and empty tokens have no place in the order and give no row; bytes that
are no UTF-8 become U+FFFD; bytes that still wait at the end are in ``left`` of the last token;
rows that share a place count in no certain order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _byte(b: Column, from_end: int) -> Column:
    """A byte counted from the end, from 1; null before the beginning."""
    at = F.when(F.octet_length(b) >= from_end, F.substring(b, -from_end, 1))
    return F.conv(F.hex(at), 16, 10).cast("int")


def waiting(b: Column) -> Column:
    """How many of the last bytes (0 to 3) begin a character that is not whole yet."""
    one, two, three = (_byte(b, k) for k in (1, 2, 3))
    more = lambda x: x.between(0x80, 0xBF)
    found = F.when(one.between(0xC2, 0xF4), 1).when(two.between(0xE0, 0xF4) & more(one), 2).when(three.between(0xF0, 0xF4) & more(two) & more(one), 3)
    return found.otherwise(0)


def pieces(tokens: DataFrame, key: str = "id", pos: str = "pos", data: str = "bytes") -> DataFrame:
    """(key, pos, piece, left) for rows (key, pos, bytes)."""
    t = tokens.select(F.col(key), F.col(pos), F.col(data).cast("binary").alias("bytes")).where("octet_length(bytes) > 0")
    order = Window.partitionBy(key).orderBy(pos)
    before = F.concat(*[F.coalesce(F.lag("bytes", k).over(order), F.unhex(F.lit(""))) for k in (3, 2, 1)])
    t = t.withColumn("before", before)
    t = t.withColumn("waits", waiting(F.col("before")))
    t = t.withColumn("whole", F.concat(F.expr("substring(before, octet_length(before) - waits + 1, waits)"), F.col("bytes")))
    t = t.withColumn("rest", waiting(F.col("whole")))
    piece = F.make_valid_utf8(F.expr("substring(whole, 1, octet_length(whole) - rest)").cast("string"))
    return t.select(key, pos, piece.alias("piece"), F.expr("substring(whole, octet_length(whole) - rest + 1, rest)").alias("left"))
