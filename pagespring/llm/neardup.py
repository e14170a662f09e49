"""MinHash near-dedup: circulant signatures, banding, exact Jaccard on full sets.

1. Every text gives its set of shingles and, by two permutations of which one is
   circularly shifted, a signature whose bands name buckets.
2. Texts with equal sets (128 bits of a digest) are one class, told apart by the set alone,
   so copies are never compared; a row of its smallest doc_id lends it its text.
3. In every bucket each class is compared with the bucket's first (linear in the
   bucket, dealt out by chunks), and the links found are contracted to components.
4. In buckets that still hold several components the members are laid in blocks by their
   component, and each pair of blocks that are not of one component is compared as a
   whole.  Only links that join something new are written.
So at every size every two classes that share a bucket end up in one component or
compared, no task holds more than two blocks, and no list of pairs is made.  Chunks and
blocks are dealt by rows and by shingles, so that long texts make more of them; a task
hashes its texts in slices as they come and keeps their sets only, 8 bytes a shingle.

With 24 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability
(1 - 0.8**4)**24 = 3e-6, and less above.

Defined results: a null, empty or wordless text has n_shingles 0, links with nothing
and is kept; a row with a null doc_id links with nothing, has a null component and is
kept; rows that share a doc_id are compared by their texts, each as a document; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, leave, likely, saved, table
from .graph import components
from .minhash import band_keys, signatures
from .shingles import flat, shingle_sets, slices

BANDS, ROWS = 24, 4
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21  # of a block, where its texts are long
SLICE = 4096
TEXT = 1 << 20  # bytes of text hashed together


def signed(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t, n_shingles, d1, d2 (digest of the set), keys (a bucket for each band)."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        leave()
        for batch in batches:
            for at, to in slices(batch.column(2), 256, TEXT):
                part = batch.slice(at, to - at)
                h, limits = shingle_sets(*flat(part.column(2)), width)
                n = np.diff(limits)
                full = np.flatnonzero(n)
                keys = np.zeros((0, bands), np.int64)
                if len(full):
                    keys = band_keys(signatures(h, np.concatenate([limits[:-1][full], limits[-1:]]), bands * rows), bands, rows)
                digests = [xxhash.xxh3_128_digest(h[limits[i] : limits[i + 1]]) for i in range(len(n))]
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    ["doc_id", "t", "n_shingles", "d1", "d2", "keys"],
                )

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n_shingles long, d1 long, d2 long, keys array<long>")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, as a matrix."""
    xa, xb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(xa, xb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out

    def places(x, sets):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        held = common[at] == x
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]

    (ra, ca), (rb, cb) = places(xa, a), places(xb, b)
    for lo in range(0, len(common), SLICE):
        width = min(SLICE, len(common) - lo)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        k = (ca >= lo) & (ca < lo + width)
        ma[ra[k], ca[k] - lo] = 1
        k = (cb >= lo) & (cb < lo + width)
        mb[rb[k], cb[k] - lo] = 1
        out += ma @ mb.T
    return out


def alike(both: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of these sizes share ``percent`` of their union, in whole numbers."""
    both = both.astype(np.int64)  # whole numbers below 2**24
    return (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (both > 0)


def compared(tasks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between components, found in tasks: rows (task, side, id, component).

    Side 0 is compared with side 1, or with itself where there is no side 1.  Pairs of
    one component are skipped; of the rest, links that join nothing new are left out.
    """

    def links(sides, comps, sets):
        a = [i for i, s in enumerate(sides) if s == 0]
        b = [i for i, s in enumerate(sides) if s == 1] or a
        if not a:
            return []
        na, nb = (np.array([len(sets[i]) for i in x], np.int64) for x in (a, b))
        both = intersections([sets[i] for i in a], [sets[i] for i in b])
        ca, cb = np.array([comps[i] for i in a]), np.array([comps[i] for i in b])
        hit = alike(both, na, nb, percent) & (ca[:, None] != cb[None, :])
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        found = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = find(ca[i]), find(cb[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(ca[i]), int(cb[j])))
        return found

    def run(batches):
        import pyarrow as pa

        leave()
        current, rows = None, ([], [], [])
        for batch in batches:
            out = []
            for at, to in slices(batch.column(3), BLOCK, TEXT):
                part = batch.slice(at, to - at)
                h, limits = shingle_sets(*flat(part.column(3)), width)
                for k, (task, *row) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    if task != current:
                        if current is not None:
                            out += links(*rows)
                        current, rows = task, ([], [], [])
                    for held, x in zip(rows, (*row, h[limits[k] : limits[k + 1]].copy()), strict=True):
                        held.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
        if current is not None and (out := links(*rows)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    t = tasks.join(texts, "id").select("task", "side", "component", "text")
    return t.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def linked(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Aggregates are written before they are joined to what they count, so that Spark can
    split a hot key of the larger side.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    rows = saved(signed(docs, width), spread=True)
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.any_value("keys").alias("keys"), F.any_value("n_shingles").alias("size"))
    # a class's id is its row's number, fixed by being written: doc_ids may be shared
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()))
    every = classes.select("id", "size", F.explode("keys").alias("key"))
    buckets = saved(every.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("key", "leader"))
    members = saved(every.join(buckets, "key"))
    n = members.count()
    # buckets with the same members (a count and the sums of two hashes tell them) are one
    marks = members.groupBy("key", "leader").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s2"),
    )
    single = saved(marks.groupBy("n", "leader", "s1", "s2").agg(F.min("key").alias("key")).select("key"), rows=n)
    members = saved(members.join(single, "key"), rows=n)
    needed = saved(classes.select("id", "rep.doc_id", "rep.t").join(members.select("id").distinct(), "id"), rows=n)
    # any of the rows that are equal in both
    texts = likely(docs, "t", needed.select("t")).join(needed, ["doc_id", "t"]).select("id", "text").dropDuplicates(["id"])
    texts = saved(texts)
    # each member against its bucket's first
    pairs = saved(members.where("id <> leader").select("leader", "id", "size").distinct(), rows=n)
    chunks = saved(pairs.groupBy("leader").agg(blocks_of(F.count("*"), F.sum("size"), 1).alias("chunks")), rows=n)
    pairs = pairs.join(chunks, "leader").withColumn("task", F.concat_ws("/", "leader", F.pmod(F.xxhash64("id"), "chunks")))
    first = pairs.select("task", "id", F.lit(1).alias("side"), F.col("id").alias("component"))
    lead = pairs.select("task", F.col("leader").alias("id")).distinct().select("task", "id", F.lit(0).alias("side"), F.col("id").alias("component"))
    comps = saved(components(saved(compared(first.union(lead), texts, width, percent))), rows=n)
    # what is left: buckets of several components, by blocks
    m = members.select("key", "id", "size").join(comps.withColumnRenamed("node", "id"), "id", "left")
    m = saved(m.select("key", "id", "size", F.coalesce("component", "id").alias("component")), rows=n)
    several = m.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    m = saved(m.join(saved(several.select("key", "n", "shingles"), rows=n), "key"), rows=n)
    joined = components(saved(compared(block_tasks(m, n), texts, width, percent)))
    by_class = classes.select("d1", "d2", "id", "rep.doc_id").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_class = by_class.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    by_class = saved(by_class.select("d1", "d2", "doc_id", F.coalesce("whole", "component").alias("component")))
    least = saved(by_class.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    by_class = saved(by_class.join(least, "component").select("d1", "d2", "component_id"))
    for done in (buckets, single, members, needed, texts, pairs, chunks, m):
        dropped(done)
    linking = F.expr("n_shingles > 0 and doc_id is not null")
    found = rows.where(linking).join(by_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where(~F.coalesce(linking, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def blocks_of(rows: Column, shingles: Column, parts: int) -> Column:
    """How many blocks these rows fill, of BLOCK / parts rows and BLOCK_SHINGLES / parts shingles."""
    return F.greatest(F.lit(1), F.ceil(rows * F.lit(parts) / F.lit(BLOCK)), F.ceil(shingles * F.lit(parts) / F.lit(BLOCK_SHINGLES)))


def block_tasks(m: DataFrame, rows: int) -> DataFrame:
    """(task, id, side, component) for ``rows`` rows (key, id, size, component, n, shingles): the
    pairs of blocks.

    A bucket's members are dealt to blocks by ranges of their component's hash, so that
    a large component fills blocks of its own; a pair of blocks that hold one and the
    same component is left out.
    """
    parts = blocks_of(F.col("n"), F.col("shingles"), 2)
    # within one component the members go on by their own hash
    per = saved(m.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("size").alias("s")), rows=rows)
    m = m.join(per, ["key", "component"])
    whole = (F.col("c") >= BLOCK) | (F.col("s") >= BLOCK_SHINGLES)
    slot = F.when(whole, F.concat_ws("/", F.lit("c"), "component", F.pmod(F.xxhash64("id"), blocks_of(F.col("c"), F.col("s"), 2)))).otherwise(
        F.concat_ws("/", F.lit("m"), F.pmod(F.xxhash64("component"), parts))
    )
    m = saved(m.select("key", "id", "component", slot.alias("block"), F.when(whole, F.col("component")).alias("pure")), rows=rows)
    blocks = m.select("key", "block", "pure").distinct()
    pairs = blocks.alias("a").join(
        blocks.select("key", F.col("block").alias("other"), F.col("pure").alias("other_pure")).alias("b"),
        "key",
    ).where("block <= other and not coalesce(pure = other_pure, false)")
    pairs = saved(pairs, rows=rows)
    task = F.concat_ws("|", "key", "block", "other")
    left = pairs.join(m.select("key", "block", "id", "component"), ["key", "block"]).select(task.alias("task"), "id", F.lit(0).alias("side"), "component")
    right = pairs.where("block < other").join(m.select("key", F.col("block").alias("other"), "id", "component"), ["key", "other"]).select(task.alias("task"), "id", F.lit(1).alias("side"), "component")
    return left.union(right)


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""
