"""Texts to token ids and back, by a tokenizer file that each Python worker loads once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a ``tokenizer.json``, kept for the worker's life."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def token_ids(text: Column, path: str, special: bool = False) -> Column:
    """A text's ids; null gives null, an empty text no ids."""

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        found = tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=special)
        return pd.Series([None if t is None else e.ids for t, e in zip(texts, found, strict=True)])

    return encode(text)


def token_text(ids: Column, path: str, skip_special: bool = True) -> Column:
    """The text of a whole sequence of ids; null gives null."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        held = tokenizer(path)
        return pd.Series([None if r is None else held.decode([int(i) for i in r], skip_special_tokens=skip_special) for r in rows])

    return decode(ids)


def streamed_text(ids: Column, path: str) -> Column:
    """The texts of the single tokens laid end to end, as a stream shows them.

    A character that several tokens make up comes out as replacement signs, other than in
    ``token_text``; null gives null.
    """

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        held = tokenizer(path)
        kept: dict[int, str] = {}

        def one(i: int) -> str:
            if i not in kept:
                kept[i] = held.decode([i], skip_special_tokens=True)
            return kept[i]

        return pd.Series([None if r is None else "".join(one(int(i)) for i in r) for r in rows])

    return decode(ids)


def vocabulary_id(token: Column, path: str) -> Column:
    """The id of a token's own string; one that the vocabulary lacks is an error."""

    @F.pandas_udf("bigint")
    def find(tokens: pd.Series) -> pd.Series:
        held = tokenizer(path)
        out = []
        for t in tokens:
            i = None if t is None else held.token_to_id(t)
            if t is not None and i is None:
                raise KeyError(f"not in the vocabulary: {t!r}")
            out.append(i)
        return pd.Series(out, dtype="Int64")

    return find(token)
