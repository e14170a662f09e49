"""Benchmark decontamination: suffix arrays of the training texts, searched by test suffixes.

1. The words of the benchmark's items are numbered (their vocabulary); a training word is its
   number, or 0 if no item has it, where every match ends.
2. The training texts of a task are laid out in shards of about SHARD words, a longer text in
   pieces that share ``window - 1`` words.  Each shard's suffixes are sorted, to the depth of
   the longest test suffix, by doubling: by as many words as one 64-bit key holds, then by
   the ranks of twice as many, as long as suffixes are tied.
3. Every suffix of every item is binary-searched in each shard.  The longer of the common
   prefixes with its two neighbours there is its longest verbatim match.
4. Where that is a window (``window`` words, or all of an item that has fewer), the suffixes
   between the window's bounds are its places.  They give a document's hit words and items.

A stretch of item words between others that is shorter than the shortest window holds no
match, and its suffixes are not sorted.  Shards are made, searched
and dropped inside the task that read the texts, so nothing is shuffled and a lost executor
costs its tasks only.  What is broadcast is a block of items of BLOCK words at most (a longer
item in pieces that share ``window - 1`` words); each further block is one more pass over the
documents, and passes grow with the benchmark alone.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, told apart by 64
hash bits; a window must agree in all of its words.

Defined results: a null, empty or wordless text has no words and is clean; a null, empty or
wordless item has no windows; items that share an item_id are one item in the counts (their
windows do not run into each other), and an item without an id marks words but is neither
counted nor named; rows that share a doc_id are documents of their own; an empty benchmark
leaves every document clean; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .shingles import _LOWER, flat, word_hashes

WINDOW = 10
SHARD = 1 << 20  # words
BLOCK = 1 << 21  # words of items that are broadcast together
PART = 1 << 19  # bytes of text whose words are hashed together

PARTING = np.ones(256, bool)
PARTING[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def hashed_words(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, limits) of the texts from .. to; a text above PART bytes comes alone,
    in pieces."""
    import xxhash

    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
        lo, hi = int(ends[at]), int(ends[to])
        while hi - lo > PART:
            parts = np.flatnonzero(PARTING[raw[lo : lo + PART + 1]])
            if len(parts):
                cut = lo + int(parts[-1]) + 1
                yield at, to, *word_hashes(raw[lo:cut], np.array([0, cut - lo]), PARTING)
            else:  # a word above PART bytes has a hash of its own
                digest, cut = xxhash.xxh3_64(), lo
                while cut < hi:
                    parts = np.flatnonzero(PARTING[raw[cut : cut + PART]])
                    end = cut + int(parts[0]) if len(parts) else min(cut + PART, hi)
                    digest.update(_LOWER[raw[cut:end]].tobytes())
                    cut = end
                    if len(parts):
                        break
                yield at, to, np.array([digest.intdigest()], np.uint64), np.array([0, 1])
            lo = cut
        yield at, to, *word_hashes(raw[lo:hi], np.maximum(ends[at : to + 1] - lo, 0), PARTING)
        at = to


def numbered(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Each word's number in the sorted vocabulary, from 1; 0 if it is not there."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int32)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at + 1, 0).astype(np.int32)


def packed(ids: np.ndarray, bits: int, per: int) -> np.ndarray:
    """The ``per`` numbers from every place in one key, the first in the highest bits."""
    padded = np.concatenate([ids, np.zeros(per, ids.dtype)]).astype(np.uint64)
    key = np.zeros(len(ids), np.uint64)
    for k in range(per):
        key = (key << np.uint64(bits)) | padded[k : k + len(ids)]
    return key


def suffix_array(ids: np.ndarray, starts: np.ndarray, keys: np.ndarray, per: int, depth: int) -> np.ndarray:
    """``starts`` sorted by the first ``depth`` (or more) numbers of their suffixes.

    ``keys`` holds the first ``per`` of every place.  Places outside ``starts`` rank below
    those inside: a suffix reaches them behind a 0, where every comparison has ended.
    """
    order = starts[np.argsort(keys[starts], kind="stable")]
    k = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[order] = np.cumsum(new)
    done = per
    while done < depth:
        # only suffixes that are tied with a neighbour are sorted again
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        first, then = rank[some], rank[np.minimum(some + done, len(ids))]
        by = np.argsort((first << 32) | then, kind="stable")
        order[at] = some[by]
        first, then = first[by], then[by]
        new[at[1:]] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        new[at[0]] = True
        # a rank is the place of its first suffix, so untied ranks stay as they are
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, len(order) + 1), 0))
        done *= 2
    return order


@dataclass(frozen=True)
class Block:
    """Items as numbers of their words, laid end to end with a 0 after each."""

    vocabulary: np.ndarray
    ids: np.ndarray
    bits: int
    suffix: np.ndarray  # where each test suffix starts
    length: np.ndarray  # words up to its item's end
    item: np.ndarray  # its item's row in ``names``
    window: np.ndarray  # words of its window, 0 where none begins
    names: np.ndarray  # item_id of each row
    named: np.ndarray
    begins: np.ndarray  # the word of its item that a row begins with
    first: np.ndarray  # its first suffix's number

    @property
    def per(self) -> int:
        return 64 // self.bits

    @property
    def least(self) -> int:
        return int(self.window[self.window > 0].min()) if (self.window > 0).any() else 0


def block_of(rows: list[tuple[int | None, np.ndarray, int, bool]], window: int) -> Block:
    """The block of (item_id, word hashes, first word in the item, is it all of the item?)."""
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[1] for r in rows)]))
    ids, suffix, length, item, least = [], [], [], [], []
    at = 0
    for k, (_, words, _, whole) in enumerate(rows):
        n = len(words)
        ids += [numbered(words, vocabulary), np.zeros(1, np.int32)]
        suffix.append(np.arange(at, at + n))
        length.append(np.arange(n, 0, -1))
        item.append(np.full(n, k))
        own = np.where(np.arange(n) + window <= n, window, 0)
        if 0 < n < window and whole:
            own[0] = n
        least.append(own)
        at += n + 1
    none = [np.zeros(0, np.int64)]
    return Block(
        vocabulary,
        np.concatenate([np.zeros(0, np.int32), *ids]),
        max(1, int(len(vocabulary)).bit_length()),
        *(np.concatenate(none + x).astype(np.int32) for x in (suffix, length, item, least)),
        np.array([0 if i is None else i for i, *_ in rows], np.int64),
        np.array([i is not None for i, *_ in rows], bool),
        np.array([r[2] for r in rows], np.int64),
        np.cumsum([0, *(len(r[1]) for r in rows)])[:-1],
    )


class Shard:
    """Training words with their suffix array, and the search of a block's suffixes in it."""

    def __init__(self, ids: np.ndarray, block: Block) -> None:
        self.ids, self.block = ids, block
        # whole stretches of known words, so that a suffix stays among the sorted to its end
        known = np.concatenate([[False], ids > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        first, stop = edges[::2], edges[1::2]
        long = stop - first >= max(block.least, 1)
        starts = ranges(first[long], stop[long])[1]
        self.keys = packed(ids, block.bits, block.per)
        self.depth = int(block.length.max(initial=0))
        self.order = suffix_array(ids, starts, self.keys, block.per, self.depth)

    def _below(self, at: np.ndarray, query: np.ndarray, n: np.ndarray, upper: bool) -> np.ndarray:
        """Is the suffix at ``at`` below the first n words from ``query`` (``upper``: or equal to
        them as far as they go)?"""
        block, per = self.block, self.block.per
        below, open_, step = np.zeros(len(at), bool), np.arange(len(at)), 0
        mine, theirs = self.keys, self.query_keys
        while len(open_):
            p, q, rest = at[open_] + step, query[open_] + step, n[open_] - step
            a = np.where(p < len(mine), mine[np.minimum(p, len(mine) - 1)], np.uint64(0))
            b = theirs[q]
            cut = np.clip((per - rest) * block.bits, 0, per * block.bits).astype(np.uint64)  # words beyond n do not count
            a, b = a >> cut, b >> cut
            below[open_] = a < b
            same = a == b
            more = same & (rest > per)
            if upper:
                below[open_[same & ~more]] = True
            open_ = open_[more]
            step += per
        return below

    def bound(self, query: np.ndarray, n: np.ndarray, upper: bool = False) -> np.ndarray:
        """How many suffixes are below the first n words from ``query``."""
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.order))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            below = self._below(self.order[mid], query[live], n[live], upper)
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
        return lo

    def common(self, at: np.ndarray, query: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Words that the suffix at ``at`` and the first n from ``query`` have in common."""
        ids, theirs = self.ids, self.block.ids
        out, open_, step = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(open_):
            p, q = at[open_] + step, query[open_] + step
            same = (step < n[open_]) & (p < len(ids))
            same &= ids[np.minimum(p, len(ids) - 1)] == theirs[np.minimum(q, len(theirs) - 1)]
            open_ = open_[same]
            step += 1
            out[open_] = step
        return out

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longest match of every test suffix and a place of it, and the bounds of its
        window's places (equal where it has none)."""
        block = self.block
        n = len(block.suffix)
        if not len(self.order) or not n:
            return (np.zeros(n, np.int64),) * 4
        self.query_keys = packed(block.ids, block.bits, block.per)
        at = self.bound(block.suffix, block.length)
        longest, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for side in (-1, 0):
            k = at + side
            some = np.flatnonzero((k >= 0) & (k < len(self.order)))
            there = self.order[k[some]]
            common = self.common(there, block.suffix[some], block.length[some])
            more = common > longest[some]
            longest[some[more]], place[some[more]] = common[more], there[more]
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        some = np.flatnonzero((block.window > 0) & (longest >= block.window))
        lo[some] = self.bound(block.suffix[some], block.window[some])
        hi[some] = self.bound(block.suffix[some], block.window[some], upper=True)
        return longest, place, lo, hi


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all values of the ranges lo .. hi."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


class Layout:
    """The documents of a shard: their words end to end, a 0 after each."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.words = 0
        self.docs: list[tuple[int, int, int]] = []  # (document's number, first word there, place here)

    def add(self, doc: int, first: int, ids: np.ndarray) -> None:
        if ids.any():
            self.docs.append((doc, first, self.words))
            self.ids += [ids, np.zeros(1, np.int32)]
            self.words += len(ids) + 1

    def placed(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document's number and the word there of places."""
        number, first, here = (np.array([d[k] for d in self.docs], np.int64) for k in range(3))
        k = np.searchsorted(here, place, "right") - 1
        return number[k], place - here[k] + first[k]

    def found(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, hit starts, hit ends, rows of items) for documents with hits."""
        if not self.words:
            return
        shard = Shard(np.concatenate(self.ids), block)
        _, _, lo, hi = shard.search()
        some = np.flatnonzero(lo < hi)
        if not len(some):
            return
        # suffixes whose windows are the same words have the same places: one stands for them
        _, one, of = np.unique(np.stack([lo[some], hi[some], block.window[some]]), axis=1, return_index=True, return_inverse=True)
        of, one = of.ravel(), some[one]
        lists = np.argsort(of, kind="stable")
        upto = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(one)))])
        which, at = ranges(lo[one], hi[one])
        doc, word = self.placed(shard.order[at])
        by = np.lexsort((word, doc))
        doc, word, which = doc[by], word[by], which[by]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        items_of: dict[bytes, np.ndarray] = {}
        for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True):
            kinds = np.unique(which[a:b])
            if (key := kinds.tobytes()) not in items_of:
                _, member = ranges(upto[kinds], upto[kinds + 1])
                items_of[key] = np.unique(block.item[some[lists[member]]])
            yield int(doc[a]), *joined(word[a:b], word[a:b] + block.window[one][which[a:b]]), items_of[key]

    def longest(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match of every test suffix, and the document and word where it begins."""
        n = len(block.suffix)
        if not self.words:
            return (np.zeros(n, np.int64),) * 3
        longest, place, _, _ = Shard(np.concatenate(self.ids), block).search()
        return longest, *self.placed(place)


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as intervals that do not touch; starts are in order."""
    top = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > top[:-1]
    first = np.flatnonzero(new)
    return starts[first], top[np.append(first[1:], len(starts)) - 1]


def shards(batches, block: Block, waiting: list[list]) -> Iterator[tuple[Layout, bool]]:
    """The layouts of rows (row, doc_id, text), and whether all documents so far end in it.

    ``waiting`` gets [row, doc_id, words, []] for each row; a caller empties it where they end.
    """
    overlap = max(int(block.window.max(initial=0)), 1) - 1
    layout = Layout()
    for batch in batches:
        raw, ends = flat(batch.column(2))
        base, last = len(waiting), -1
        waiting.extend([r, d, 0, []] for r, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for a, b, words, limits in hashed_words(raw, ends):
            ids = numbered(words, block.vocabulary)
            for k in range(a, b):
                own, n = ids[limits[k - a] : limits[k - a + 1]], waiting[base + k][2]
                waiting[base + k][2] = n + len(own)
                if k == last and overlap:  # a further piece: the last words before it go along
                    own = np.concatenate([before[-overlap:], own])
                layout.add(base + k, waiting[base + k][2] - len(own), own)
                before, last = own, k
                if layout.words >= SHARD:
                    yield layout, False
                    layout = Layout()
        if layout.words >= SHARD // 2 or len(waiting) >= 1 << 15:
            yield layout, True
            layout = Layout()
    yield layout, True


COLUMNS = ["row", "doc_id", "n_words", "starts", "ends", "items"]
SCHEMA = "row long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"


def searched(docs: DataFrame, block: Block) -> DataFrame:
    """A row for each row (row, doc_id, text): its words, hit intervals and items."""
    held = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK words at most

    def run(batches):
        import pyarrow as pa

        block, waiting = held.value, []

        def made():
            columns: list[list] = [[] for _ in COLUMNS]
            for row, doc, n, found in waiting:
                s = e = items = np.zeros(0, np.int64)
                if found:
                    s, e = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    by = np.argsort(s, kind="stable")
                    s, e = joined(s[by], e[by])
                    rows = np.unique(np.concatenate([f[2] for f in found]))
                    items = np.unique(block.names[rows[block.named[rows]]])
                for c, v in zip(columns, (row, doc, n, s, e, items), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], COLUMNS)

        for layout, ended in shards(batches, block, waiting):
            for number, *hits in layout.found(block):
                waiting[number][3].append(hits)
            if ended and waiting:
                yield made()
                waiting.clear()

    return docs.select("row", "doc_id", "text").mapInArrow(run, SCHEMA)


def benchmark_blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """The items in blocks of BLOCK words at most, one in the driver's memory at a time."""
    import pyarrow as pa

    rows: list[tuple[int | None, np.ndarray, int, bool]] = []
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        raw, ends = flat(pa.array([r["text"] or ""], pa.large_string()))
        words = np.concatenate([np.zeros(0, np.uint64), *(w for _, _, w, _ in hashed_words(raw, ends))])
        step = BLOCK - window
        for at in range(0, max(len(words), 1), step):
            piece = words[at : at + step + window - 1]
            if held + len(piece) > BLOCK and rows:
                yield block_of(rows, window)
                rows, held = [], 0
            rows.append((r["item_id"], piece, at, len(words) == len(piece)))
            held += len(piece)
    yield block_of(rows, window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit intervals of words (starts, ends) and items, for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = benchmark_blocks(benchmark, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return searched(docs.withColumn("row", F.lit(0).cast("long")), first).drop("row")
    # a document's number is fixed by being written
    docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), spread=True)
    whole = saved(searched(docs, first), spread=True).union(saved(searched(docs, second), spread=True))
    for block in blocks:
        whole = whole.union(saved(searched(docs, block), spread=True))
    hits = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    per = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), hits.alias("hits"), items.alias("items"))

    @F.pandas_udf("starts array<long>, ends array<long>")
    def union(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        both = [joined(np.asarray(s), np.asarray(e)) if len(s) else (s, e) for s, e in zip(starts, ends, strict=True)]
        return pd.DataFrame({"starts": [x[0] for x in both], "ends": [x[1] for x in both]})

    per = per.withColumn("hits", union(F.col("hits.starts"), F.col("hits.ends")))
    return per.select("doc_id", "n_words", "hits.starts", "hits.ends", "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, at, words, doc_id, doc_at: the longest verbatim match of every item suffix (from
    word ``at``) that has one of a window or more, and a place of it (the smallest doc_id, and
    word, of those that tasks name)."""
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = None
    for block in benchmark_blocks(benchmark, window):
        held = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK words at most

        def run(batches, held=held):
            import pyarrow as pa

            block, waiting = held.value, []
            best, where = np.zeros(len(block.suffix), np.int64), {}
            for layout, ended in shards(batches, block, waiting):
                longest, number, word = layout.longest(block)
                for k in np.flatnonzero(longest > best):
                    where[int(k)] = (waiting[number[k]][1], int(word[k]))
                best = np.maximum(best, longest)
                if ended:
                    waiting.clear()
            some = [k for k in where if block.window[k] and best[k] >= block.window[k]]
            ids = [int(block.names[block.item[k]]) if block.named[block.item[k]] else None for k in some]
            at = [int(block.begins[block.item[k]] + k - block.first[block.item[k]]) for k in some]
            rows = [ids, at, [int(best[k]) for k in some], [where[k][0] for k in some], [where[k][1] for k in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["item_id", "at", "words", "doc_id", "doc_at"])

        found = docs.mapInArrow(run, "item_id long, at long, words long, doc_id long, doc_at long")
        whole = found if whole is None else whole.union(found)
    place = F.struct((-F.col("words")).alias("less"), "doc_id", "doc_at")
    best = whole.groupBy("item_id", "at").agg(F.min(place).alias("m"))
    return best.select("item_id", "at", (-F.col("m.less")).alias("words"), "m.doc_id", "m.doc_at")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The doc_id of the documents that no window of the benchmark occurs in."""
    return contamination(docs, benchmark, window).where(F.size("starts") == 0).select("doc_id")


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, n: a + n)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return c.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS gram FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0), unnest(range(len(w) - n + 1)) AS u(p)
), g AS (
  SELECT doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') AS gram FROM (SELECT * FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n), unnest(range(len(w) - n + 1)) AS u(p)
), o AS (
  SELECT g.doc_id, g.p, g.n, i.item_id FROM g JOIN i ON i.gram = g.gram AND i.n = g.n
), h AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM o), unnest(range(n)) AS u(k) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
