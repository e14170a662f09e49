"""Byte-level BPE in DataFrame functions: distinct pieces are encoded once and joined back.

A text is cut into pieces by the tokenizer's pattern.  A piece starts as its bytes, and a fold
joins the pair of the smallest rank, the leftmost first, until no pair of neighbours has a rank.
Ranks and ids are one constant of the plan, so a look-up is a place in an array.  The ids of the
FREQUENT commonest pieces are broadcast (pieces of SHORT bytes at most, so their size is bounded);
the others meet their pieces in a shuffle, which holds no hot key then.

The fold is quadratic in a piece's length: pieces above LONGEST bytes are encoded by the
tokenizer itself, in Arrow batches, with the same ids.

Defined results: null and empty texts have an empty array of ids; rows that share a key are rows
of their own; the strings of special tokens are plain text; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

#: Fixed value: the pattern of byte-level tokenizers of this kind.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST, SHORT, FREQUENT = 256, 32, 1 << 16
BUCKETS = 1 << 16
_NONE = 2**31 - 1


def alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters
    stand for themselves, those from U+0100 on for the other bytes in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(4)
def _table(path: str) -> str:
    """JSON of BUCKETS maps, by crc32 of the key: "left right" to rank, "token" to id, in hex."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = alphabet()

    def coded(token: str) -> str:
        return bytes(letters[c] for c in token).hex().upper()

    special = {t for t in model["vocab"] if any(c not in letters for c in t)}
    entries = {coded(t): i for t, i in model["vocab"].items() if t not in special}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        entries[f"{coded(left)} {coded(right)}"] = rank
    held: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        held[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return json.dumps(held)


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _found(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)


def _rank(table: Column, left: Column, right: Column) -> Column:
    return F.coalesce(_found(table, F.concat_ws(" ", left, right)), F.lit(_NONE))


def _joined(table: Column, state: Column) -> Column:
    """One step: the leftmost pair of the smallest rank becomes one symbol."""
    s, r = state["s"], state["r"]
    none = F.array().cast("array<int>")

    def at(p: Column) -> Column:
        def with_symbol(new: Column) -> Column:
            left = F.when(p > 1, F.array(_rank(table, F.get(s, p - 2), new))).otherwise(none)
            right = F.when(p + 1 < F.size(s), F.array(_rank(table, new, F.get(s, p + 1)))).otherwise(none)
            symbols = F.concat(F.slice(s, F.lit(1), p - 1), F.array(new), F.slice(s, p + 2, F.size(s)))
            ranks = F.concat(F.slice(r, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(r, p + 2, F.size(s)))
            return F.struct(symbols.alias("s"), ranks.alias("r"))

        return _let(F.concat(F.get(s, p - 1), F.get(s, p)), with_symbol)

    def by_least(m: Column) -> Column:
        return F.when(m == _NONE, state).otherwise(_let(F.array_position(r, m).cast("int"), at))

    return _let(F.coalesce(F.array_min(r), F.lit(_NONE)), by_least)


def piece_ids(piece: Column, path: str) -> Column:
    """The ids of one piece of text, by the merges of a byte-level tokenizer file."""

    def encode(table: Column) -> Column:
        def folded(s: Column) -> Column:
            n = F.size(s)
            ranks = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n), lambda a, b: F.when(b.isNotNull(), _rank(table, a, b)))
            start = F.struct(s.alias("s"), ranks.alias("r"))
            steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
            return F.aggregate(steps, start, lambda state, _: _joined(table, state), lambda state: F.transform(state["s"], lambda x: _found(table, x)))

        return _let(F.regexp_extract_all(F.hex(F.encode(piece, "utf-8")), F.lit(".."), F.lit(0)), folded)

    return _let(F.from_json(F.lit(_table(path)), "array<map<string,int>>"), encode)


def _by_tokenizer(piece: Column, path: str) -> Column:
    @F.pandas_udf("array<int>")
    def encode(pieces: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.encode_special_tokens = True
        return pd.Series([e.ids for e in held.encode_batch(list(pieces), add_special_tokens=False)])

    return encode(piece)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row, by a byte-level BPE tokenizer file."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = written(rows)
    pieces = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    words = written(rows.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")))
    long = F.octet_length("piece") > LONGEST
    ids = words.where(~long).withColumn("ids", piece_ids(F.col("piece"), path))
    ids = written(ids.union(words.where(long).withColumn("ids", _by_tokenizer(F.col("piece"), path))))
    common = F.broadcast(ids.where(F.octet_length("piece") <= SHORT).orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece", "ids"))
    # texts go by row once, so what is met by broadcast is gathered without a shuffle
    met = rows.repartition("row").select("row", "key", F.posexplode_outer(pieces).alias("pos", "piece")).join(common, "piece", "left")
    met = met.groupBy("row", "key").agg(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))).alias("met"))
    rare = rows.select("row", F.posexplode(pieces).alias("pos", "piece")).join(common, "piece", "left_anti").join(ids.select("piece", "ids"), "piece")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("pos", "ids")).alias("rare"))
    both = F.array_sort(F.concat("met", F.coalesce("rare", F.array().cast("array<struct<pos:int,ids:array<int>>>"))))
    return met.join(rare, "row", "left").select(F.col("key").alias(key), F.flatten(F.transform(both, lambda x: x["ids"])).alias("ids"))
