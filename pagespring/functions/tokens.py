"""Token sequences in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without(tokens: Column, special: list[int]) -> Column:
    """Tokens that are not special, repeats kept (``array_except`` would drop them)."""
    return F.filter(tokens, lambda t: ~t.isin(*special))


def until(tokens: Column, end: int) -> Column:
    """Tokens up to and including the first end token, all if there is none."""
    at = F.array_position(tokens, F.lit(end).cast("bigint"))
    return F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens)


def tail(tokens: Column, n: int = 64) -> Column:
    """The last n tokens, all of a shorter sequence."""
    return F.slice(tokens, F.greatest(F.size(tokens) - (n - 1), F.lit(1)), F.lit(n))


def ends_with(tokens: Column, suffix: list[int]) -> Column:
    k = len(suffix)
    last = F.slice(tokens, F.greatest(F.size(tokens) - (k - 1), F.lit(1)), F.lit(k))
    return (F.size(tokens) >= k) & (last == F.array(*[F.lit(s).cast("bigint") for s in suffix]))


def recogniser_prompt(n_image: Column, system: list[int], user: list[int], assistant: list[int], start: int, end: int, newline: int, pad: int) -> Column:
    """Chat-shaped prompt ids around ``n_image`` image placeholders."""

    def fixed(*ids: int) -> Column:
        return F.array(*[F.lit(i).cast("bigint") for i in ids])

    return F.concat(
        fixed(start, *system, end, newline, start, *user),
        F.array_repeat(F.lit(pad).cast("bigint"), n_image.cast("int")),
        fixed(end, newline, start, *assistant),
    )


def last(values: Column) -> Column:
    """The final entry, null without any."""
    return F.try_element_at(values, F.lit(-1))


def looked_up(vocabulary: Column, key: Column) -> Column:
    """A map's entry; a key that the map lacks is an error, not a null."""
    found = F.try_element_at(vocabulary, key)
    return F.when(F.map_contains_key(vocabulary, key), found).otherwise(F.raise_error(F.concat(F.lit("not in the vocabulary: "), key.cast("string"))))


def greedy(start: Column, logits: Column, limit: int, end: int, penalty: float = 1.1, window: int = 64, barred: tuple[int, ...] = ()) -> Column:
    """Greedy decoding from recorded logits: a fold whose state is the tokens so far.

    ``logits``: array by token of the scores that follow it.  Each step takes the last
    token's row, bars ids from the second step on, damps what the last ``window`` tokens
    hold and appends the argmax; after ``end`` or ``limit`` new tokens nothing is added.
    """
    from .vectors import argmax, masked, repeat_penalised

    def step(tokens: Column, k: Column) -> Column:
        row = F.get(logits, last(tokens).cast("int"))
        row = repeat_penalised(row, tail(tokens, window), penalty)
        if barred:
            row = F.when(k > 1, masked(row, list(barred))).otherwise(row)
        done = (k > 1) & (last(tokens) == end)
        return F.when(done, tokens).otherwise(F.concat(tokens, F.array(argmax(row))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step)
