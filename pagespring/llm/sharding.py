"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, sorted by falling size, each enter the bin with the tightest
remaining capacity that holds them, found through a balanced tree.

Groups of one size are interchangeable, so what is packed in order is the list of sizes with
their counts: groups of a size go on into one bin while it holds them, for it stays the
tightest.  Different sizes add up to no more than the whole, so that list has at most
sqrt(2 * bytes) rows; it is sorted and streamed through one task that keeps the bins alone,
and gives a run of ranks for each size and bin.  A group's rank among those of its size is
counted in parts, and a join on the size finds its run.  Groups stay whole: one
above the equal share gets a bin to itself, and the other bins share the rest equally.
Rows are numbered in parts of a shard, so a shard that one group swells is still numbered
by many tasks.

Defined results: a null text has no bytes (size 16) and crc 0 and all null texts
are one group, apart from empty texts only by their hash; repeated rows are rows of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

OVERHEAD = 16
PARTS = 256
ROWS_A_PART = 1_000_000
SHARDS = 40


class BinTree:
    """AVL tree of (remaining capacity, bin), to find the least that suffices."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(n: list | None) -> int:
        return n[3] if n else 0

    @classmethod
    def _fixed(cls, n: list) -> list:
        n[3] = 1 + max(cls._height(n[1]), cls._height(n[2]))
        lean = cls._height(n[1]) - cls._height(n[2])
        if abs(lean) < 2:
            return n
        near, far = (1, 2) if lean > 1 else (2, 1)
        child = n[near]
        if cls._height(child[far]) > cls._height(child[near]):
            n[near] = cls._turned(child, far, near)
        return cls._turned(n, near, far)

    @classmethod
    def _turned(cls, n: list, near: int, far: int) -> list:
        top = n[near]
        n[near], top[far] = top[far], n
        for x in (n, top):
            x[3] = 1 + max(cls._height(x[1]), cls._height(x[2]))
        return top

    def add(self, key: tuple[int, int]) -> None:
        def put(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = put(n[side])
            return self._fixed(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(n, k):
            if n[0] == k:
                if n[1] is None or n[2] is None:
                    return n[1] or n[2]
                least = n[2]
                while least[1]:
                    least = least[1]
                n[0] = least[0]
                n[2] = cut(n[2], least[0])
            else:
                side = 1 if k < n[0] else 2
                n[side] = cut(n[side], k)
            return self._fixed(n)

        self.root = cut(self.root, key)

    def least_from(self, size: int) -> tuple[int, int] | None:
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        return best

    def most(self) -> tuple[int, int] | None:
        n = self.root
        while n and n[2]:
            n = n[2]
        return n[0] if n else None


def best_fit_runs(classes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(size, bin, from, to): which items of each size, by rank, enter a bin; for (size, count)
    pairs by falling size.

    Without ``bins`` a bin is opened when none has room (an item above the capacity
    gets a bin of its own).  With ``bins`` exactly that many are open from the start
    and what fits nowhere enters the emptiest.
    """
    tree, opened = BinTree(), 0
    for b in range(bins or 0):
        tree.add((capacity, b))
    for size, count in classes:
        at = 0
        while at < count:
            found = tree.least_from(size)
            if found is None and bins:
                found = tree.most()
            if found is None:
                found, opened = (max(capacity, size), opened), opened + 1
            else:
                tree.remove(found)
            # it stays the tightest that holds another one
            n = min(count - at, max(1, found[0] // size))
            tree.add((found[0] - n * size, found[1]))
            yield size, found[1], at, at + n
            at += n


def best_fit_decreasing(sizes: Iterable[tuple[int, object]], capacity: int, bins: int | None = None) -> Iterator[tuple[object, int]]:
    """(item, bin) for (size, item) pairs in memory, ties by item; bins as in ``best_fit_runs``."""
    ranked = {size: [x[1] for x in own] for size, own in groupby(sorted(sizes, key=lambda x: (-x[0], x[1])), lambda x: x[0])}
    for size, b, lo, hi in best_fit_runs(((size, len(own)) for size, own in ranked.items()), capacity, bins):
        for item in ranked[size][lo:hi]:
            yield item, b


def fair_capacity(sizes: Iterable[int], bins: int, total: int | None = None) -> int:
    """The equal share of the bins, once items above their share have a bin of their own.
    Where ``total``, the sum of all, is given, the ``bins`` largest sizes will do."""
    rest, left = sorted(sizes, reverse=True), bins
    total = sum(rest) if total is None else total
    for size in rest:
        if left < 2 or size * left <= total:
            break
        total, left = total - size, left - 1
    return max(1, -(-total // left))


def poured(classes: DataFrame, capacity: int, bins: int) -> DataFrame:
    """(bytes, shard, from, to) for rows (bytes, count), in one task that streams them."""

    def run(batches):
        import pyarrow as pa

        sizes = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        runs = best_fit_runs(sizes, capacity, bins)
        while some := list(islice(runs, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["bytes", "shard", "from", "to"])

    # at most sqrt(2 * total bytes) rows
    return classes.select("bytes", "count").repartition(1).sortWithinPartitions(F.desc("bytes")).mapInArrow(run, "bytes long, shard int, from long, to long")


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) among those of their key.  rows have a part: a key's
    parts are numbered by tasks of their own, each after the parts before it."""
    counts = rows.groupBy(key, "part").count()
    before = counts.select(key, "part", (F.sum("count").over(Window.partitionBy(key).orderBy("part")) - F.col("count")).alias("before"))
    within = Window.partitionBy(key, "part").orderBy(*order)
    numbered = rows.withColumn("n", F.row_number().over(within) - 1).join(before, [key, "part"])
    return numbered.withColumn(name, (F.col("before") + F.col("n")).cast("long")).drop("n", "before")


def md5_long(c):
    """60 bits of a text's md5, as other engines give them too."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(md5_long(F.col("text")), F.lit(-1)).alias("h"),
    )
    rows = saved(rows, spread=True)
    group = ["h", "size", "text_crc32"]
    counted = saved(rows.groupBy(*group).agg((F.count("*") * F.col("size")).alias("bytes")))
    classes = saved(counted.groupBy("bytes").count())
    total, groups = classes.agg(F.sum(F.col("bytes") * F.col("count")), F.sum("count")).first()
    largest = [r["bytes"] for r in classes.orderBy(F.desc("bytes")).limit(shards).collect() for _ in range(min(r["count"], shards))]
    runs = saved(poured(classes, fair_capacity(largest, shards, total or 0), shards))

    def part(n: int | None, by):
        return F.pmod(by, F.lit(max(PARTS, (n or 0) // ROWS_A_PART))).cast("int")

    numbered = ranked(counted.withColumn("part", part(groups, F.col("h"))), "bytes", group, "rank")
    placed = numbered.join(runs, "bytes").where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))).select(*group, "shard")
    # written, so that Spark can split a hot group of rows
    keyed = rows.join(saved(placed), group).withColumn("part", part(rows.count(), F.coalesce(md5_long(F.col("doc_id").cast("string")), F.col("h"))))
    return ranked(keyed, "shard", ["doc_id", "text_crc32", "size", "h"], "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_shard(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: For tables of fewer than ROWS_A_PART * PARTS rows.  The polynomial of CRC-32 is a fixed value.
OP9_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, n) ORDER BY n) AS t FROM range(256) AS u(n)
), b AS (
  SELECT doc_id, text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents
), d AS (
  SELECT doc_id, n + {OVERHEAD} AS size, CASE WHEN text IS NULL THEN -1 ELSE CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) END AS h,
    CAST(xor(list_reduce(list_transform(range(n), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda a, y: xor(a // 256, t.t[1 + xor(a % 256, y)]), 4294967295), 4294967295) AS BIGINT) AS text_crc32
  FROM b, t
), g AS (
  SELECT h, size, text_crc32, CAST(count(*) * size AS BIGINT) AS bytes FROM d GROUP BY h, size, text_crc32
), o AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, (h + {PARTS}) % {PARTS}, h, size, text_crc32) AS step FROM g
), f AS (  -- the largest groups, until one is no more than an equal share of what is left
  SELECT bytes, greatest(1, {SHARDS} + 1 - step) AS bins, (SELECT sum(bytes) FROM g) - coalesce(sum(bytes) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, step
  FROM (SELECT bytes, step FROM o UNION ALL SELECT 0, (SELECT count(*) + 1 FROM o))
), cap AS (
  SELECT greatest(1, CAST((rest + bins - 1) // bins AS BIGINT)) AS cap FROM f WHERE bins < 2 OR bytes * bins <= rest ORDER BY step LIMIT 1
), p(step, room, bin) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(cap) FROM cap, range({SHARDS})), CAST(0 AS BIGINT)
  UNION ALL SELECT step, list_transform(range(1, {SHARDS} + 1), lambda i: CASE WHEN i = pick THEN room[i] - bytes ELSE room[i] END), pick
  FROM (
    SELECT o.step, o.bytes, p.room, CAST(CASE WHEN list_max(p.room) >= o.bytes THEN list_position(p.room, list_min(list_filter(p.room, lambda r: r >= o.bytes)))
      ELSE {SHARDS} + 1 - list_position(list_reverse(p.room), list_max(p.room)) END AS BIGINT) AS pick
    FROM p JOIN o ON o.step = p.step + 1
  )
), r AS (
  SELECT d.*, CAST(p.bin - 1 AS INTEGER) AS shard, CASE WHEN d.doc_id IS NULL THEN (d.h + {PARTS}) % {PARTS} ELSE CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {PARTS} END AS part
  FROM d JOIN o ON o.h = d.h AND o.size = d.size AND o.text_crc32 = d.text_crc32 JOIN p ON p.step = o.step
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size, h) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r
"""
