"""Exact BM25 top-k search: block-max WAND pruning per shard, merged exactly.

Words are runs of ASCII letters and digits and of any bytes above 0x7f, with A-Z
lower-cased.  A query is a text, its terms are its distinct words.

The inverted index is built once, in one pass over the texts, and written: a row for each
shard (SHARD_ROWS documents or SHARD_BYTES of text at most) with its terms' postings in
order of documents, which are laid out by length.  Global statistics (documents, mean
length, document frequency of each term) are sums over the shards.  Queries go in blocks of
about BLOCK_TERMS terms, broadcast with their statistics: their size is set by the block,
not by the corpus, and each block is answered from the index.

A list's blocks are its postings in ranges of BLOCK documents, each with its largest impact;
lists of FREQUENT of a shard's documents or more hold their counts by document, so that a cursor
goes to any document at once.  Lists with less, whose terms weigh most, are read in full: only a
document that they or the blocks' bounds lift to the threshold can be a hit.  The shallow move
adds the bounds of the other lists' blocks, one for BLOCK documents, for SLICE queries in one
product of matrices.  Without a threshold, a few documents of the largest sums over the rare lists
set one.  The pivots, the documents whose bounds reach it, are taken in document order, RUN and
then twice as many at a time.  The lists' cursors go from pivot to pivot, lists of the largest
maximum first: what is read takes the place of the block's bound, documents that fall below the
threshold are no pivots for the lists that follow, and what lies between pivots is never read.
Documents left at the end are scored in double precision and raise the threshold.  The shards' top k are merged by score and
doc_id, in groups of shards first.  The square root of the shards' number of them answer
before the others, and the k-th best score that they have between them is where the others'
thresholds start: these skip more, and give about k times that root of hits a query in all
instead of k each.  A task's later shards start from what its earlier ones have found as well.  Nothing is approximated: scores are rounded to nine
places before they are compared, ties go to the smaller doc_id, and a document is only
skipped if its bound is clearly lower.  Terms are told apart by 54 bits.

Defined results: a null or empty query gives no rows; null and empty texts match no
query but count as documents of length 0; documents that share no term are not
returned; repeated rows are ranked as documents of their own, but query rows that share
a query_id are one query of all their terms; a null doc_id is no query and sorts last; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch, table
from .shingles import flat, slices, word_hashes

K, K1, B = 10, 1.2, 0.75
BLOCK, STRIDE = 20, 1
RUN = 4096
ENTERED = 8192  # pivots times lists that a deep move takes at once, if the pivots are few
SLICE = 512
BLOCK_TERMS = 1_000_000
SHARD_ROWS = 10_000
SHARD_BYTES = 32 << 20
FREQUENT = 0.08
_LAST = np.iinfo(np.int64).max
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the distinct terms of each text, and the texts' lengths.

    Takes SLICE texts at most, so that text and term (54 bits of its hash) are one key.
    """
    raw, ends = flat(column)
    words, at = word_hashes(raw, ends, _PARTS)
    n = np.diff(at)
    key = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(54)) | (words >> np.uint64(10)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    key = key[first]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), np.diff(np.append(first, len(words))), n


#: A shard of the index: its documents' ids and lengths by length, and its terms with their
#: document frequencies and postings (document, count), as little-endian arrays.
INDEX = "shard long, docs int, words long, ids binary, lengths binary, terms binary, df binary, doc binary, count binary"


def index(docs: DataFrame) -> DataFrame:
    """The inverted index of (doc_id, text): a row a shard, see INDEX."""

    def run(batches):
        import pyarrow as pa

        number = -1

        def shard(rows):
            nonlocal number
            number += 1
            ids, length = (np.concatenate([r[k] for r in rows]) for k in (0, 4))
            base = np.cumsum([0, *(len(r[0]) for r in rows)])
            doc = np.concatenate([r[1] + b for r, b in zip(rows, base, strict=False)])
            term, count = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
            by_length = np.argsort(length, kind="stable")
            turn = np.empty(len(ids), np.int64)
            turn[by_length] = np.arange(len(ids))
            doc = turn[doc]
            order = np.lexsort((doc, term))
            term = term[order]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.append(first, len(term)))
            columns = (ids[by_length], length[by_length].astype(np.int64), term[first], df.astype(np.int32), doc[order].astype(np.uint16), count[order].astype(np.int32))
            arrays = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([int(length.sum())], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "docs", "words", "ids", "lengths", "terms", "df", "doc", "count"])

        rows, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:  # the rows' partition, whatever task takes it
                number = max(number, (batch.column(2)[0].as_py() << 32) - 1)
            for at, to in slices(batch.column(1), SLICE, 4 << 20):
                part = batch.slice(at, to - at)
                doc, terms, count, length = term_counts(part.column(1))
                rows.append((part.column(0).fill_null(int(_LAST)).to_numpy(), doc.astype(np.int32), terms, count.astype(np.int32), length))
                n, size = n + len(length), size + part.column(1).nbytes
                if n + SLICE > SHARD_ROWS or size >= SHARD_BYTES:
                    yield shard(rows)
                    rows, n, size = [], 0, 0
        if rows:
            yield shard(rows)

    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("partition")).mapInArrow(run, INDEX)


class Queries:
    """A block of queries: ids, and their terms as places in the sorted vocabulary."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray]) -> None:
        self.ids = ids
        self.limits = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        every = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.vocabulary, self.terms = np.unique(every, return_inverse=True)
        self.idf, self.mean = np.zeros(len(self.vocabulary)), 1.0
        self.floors = np.zeros(len(ids))  # scores that k documents are known to reach

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the vocabulary, -1 where it has none."""
        if not len(self.vocabulary):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1)


class Shard:
    """A shard's lists for the terms of a block of queries, in blocks with their largest impacts."""

    def __init__(self, ids, lengths, terms, df, doc, count, q: Queries, k1: float, b: float) -> None:
        self.ids, n = ids, len(ids)
        place = q.places(terms)
        own = place >= 0
        starts = (np.cumsum(df) - df)[own]
        df, place = df[own], place[own]
        order = np.argsort(place)
        starts, df, place = starts[order], df[order], place[order]
        sizes = np.zeros(len(q.vocabulary), np.int64)
        sizes[place] = df
        self.of = np.concatenate([[0], np.cumsum(sizes)])
        post = np.arange(self.of[-1]) - np.repeat(np.cumsum(df) - df, df) + np.repeat(starts, df)
        self.doc, self.count = doc[post], count[post]
        self.idf, self.k1, self.norm = q.idf, k1, k1 * (1 - b + b * lengths / q.mean)
        impact = self.impacts(slice(None), np.repeat(place, df))
        self.rough = impact.astype(np.float32)  # for bounds: what is read again and again is small
        # frequent lists have their counts by document, and a row of bounds for their blocks
        frequent = np.flatnonzero(sizes >= max(2, FREQUENT * n))
        self.blocks, self.lists = -(-n // BLOCK), frequent
        self.row = np.full(len(sizes), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.held = np.zeros((len(frequent), n), np.uint16 if self.count.max(initial=0) < 1 << 16 else np.int32)
        self.largest = np.zeros((len(frequent), self.blocks))
        for r, t in enumerate(frequent):
            at = slice(self.of[t], self.of[t + 1])
            self.held[r, self.doc[at]] = self.count[at]
            full = np.zeros(self.blocks * BLOCK)
            full[self.doc[at]] = impact[at]
            self.largest[r] = full.reshape(-1, BLOCK).max(1)
        self.lead = self.largest.max(1, initial=0)
        # what the queries read: bounds of blocks, places of cursors (of those that their lists have), postings
        self.bounds_read = self.blocks_met = self.blocks_entered = self.postings_read = 0

    def impacts(self, post, term: np.ndarray) -> np.ndarray:
        """The impacts of these postings, of these terms."""
        count = self.count[post]
        return self.idf[term] * count * (self.k1 + 1) / (count + self.norm[self.doc[post]])

    def places(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of these stretches of postings, one after the other."""
        self.postings_read += int(sizes.sum())
        post = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        post += np.arange(len(post))
        return post

    def summed(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The impacts of these stretches of postings, by document."""
        post = self.places(starts, sizes)
        term = np.repeat(np.searchsorted(self.of, starts, "right") - 1, sizes)
        return np.bincount(self.doc[post], self.impacts(post, term), len(self.ids))

    def block_bounds(self, queries: list[np.ndarray]) -> np.ndarray:
        """The shallow move of several queries at once: each one's sum of its frequent lists'
        largest impacts in every block, as a product of two matrices."""
        held = np.zeros((len(queries), len(self.largest)))
        for n, terms in enumerate(queries):
            rows = self.row[terms]
            held[n, rows[rows >= 0]] = 1
        lists = int(held.sum())
        self.bounds_read += lists * self.blocks
        self.blocks_met += lists * len(self.ids)
        return held @ self.largest

    def entered(self, rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """The deep move: what these lists add to each pivot; their cursors go to it at once."""
        count = self.held[rows[:, None], pivots]
        self.blocks_entered += count.size
        self.postings_read += int(np.count_nonzero(count))
        part = count / (count + self.norm[pivots])
        part *= (self.idf[self.lists[rows]] * (self.k1 + 1))[:, None]
        return part.sum(0)  # list by list: equal documents get equal sums

    def top(self, terms: np.ndarray, k: int, floor: float = 0.0, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(doc, score) of the best k that reach the floor, best first; see ``found``."""
        return self.found(terms, k, floor, bounds)[:2]

    def found(self, terms: np.ndarray, k: int, floor: float, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, score, the score before it was rounded) of the best k that reach the floor, best
        first; ``bounds``: the query's row of ``block_bounds``."""
        if bounds is None:
            bounds = self.block_bounds([terms])[0]
        rows = self.row[terms]
        rare, rows = terms[rows < 0], rows[rows >= 0]
        heavy = rows[np.argsort(-self.lead[rows], kind="stable")]
        sizes = self.of[rare + 1] - self.of[rare]
        post = self.places(self.of[rare], sizes)
        doc = self.doc.take(post)
        sure = np.bincount(doc, self.rough.take(post), self.blocks * BLOCK)
        docs, scores, sums, least = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), floor
        reach = sure.reshape(-1, BLOCK).max(1, initial=0) + bounds
        slack = 1e-7 + 1e-6 * reach.max(initial=0)  # bounds are sums in single precision

        def scored(pivots: np.ndarray) -> None:
            nonlocal docs, scores, sums, least
            marked = np.zeros(len(self.ids), bool)
            marked[pivots] = True
            held = np.flatnonzero(marked[doc])
            score = np.bincount(doc[held], self.impacts(post[held], np.repeat(rare, sizes)[held]), len(self.ids))[pivots]
            score = score + self.entered(rows, pivots)  # of no postings at all, bincount gives integers
            hit = np.round(score, 9) > 0
            docs, sums = np.concatenate([docs, pivots[hit]]), np.concatenate([sums, score[hit]])
            scores = np.round(sums, 9)
            best = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores, sums = docs[best], scores[best], sums[best]
            if len(docs) == k:
                least = max(floor, scores[-1])

        first = np.zeros(0, np.int64)
        if not floor and len(self.ids) > 6 * k:
            first = np.sort(np.argpartition(-sure[: len(self.ids)], 6 * k)[: 6 * k])
            scored(first)
        # blocks, then documents whose bounds reach the threshold
        need = max(least - slack, 1e-12)
        some = np.flatnonzero(reach >= need)
        rest = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rest, bound = self.reaching(rest, sure[rest] + np.repeat(bounds[some], BLOCK), need)
        if len(first):
            new = ~np.isin(rest, first, assume_unique=True)
            rest, bound = rest[new], bound[new]
        run = RUN
        while len(rest):
            rest, bound = self.reaching(rest, bound, least - slack)
            now, reach, rest, bound = rest[:run], bound[:run], rest[run:], bound[run:]  # the next pivots, in document order
            at = 0
            while at < len(heavy) and len(now) > 4 * k:
                part = heavy[at : at + max(4, at, ENTERED // len(now))]
                reach = reach + (self.entered(part, now) - self.largest[part].sum(0)[now // BLOCK])
                now, reach = self.reaching(now, reach, least - slack)
                at += len(part)
            if len(now):
                scored(now)
            run *= 2
        return docs[scores >= floor], scores[scores >= floor], sums[scores >= floor]

    def tops(self, queries: list[np.ndarray], k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``found`` of each query; raises the floors to the k-th scores found."""
        out = []
        for n, (terms, bounds) in enumerate(zip(queries, self.block_bounds(queries), strict=True)):
            out.append(self.found(terms, k, floors[n], bounds))
            if len(out[-1][1]) == k:
                floors[n] = max(floors[n], out[-1][1][-1])
        return out

    def reaching(self, docs: np.ndarray, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The documents, with their bounds, whose bound is least or more."""
        still = (bound >= least) & (docs < len(self.ids))
        return docs[still], bound[still]


def frequencies(made: DataFrame, held) -> DataFrame:
    """(place, df): documents that hold each term of the block."""

    def run(batches):
        import pyarrow as pa

        q = held.value
        df = np.zeros(len(q.vocabulary), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms, own = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((0, np.uint64), (1, np.int32)))
                place = q.places(terms)
                df[place[place >= 0]] += own[place >= 0]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["place", "df"])

    return made.select("terms", "df").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))


def shard_tops(made: DataFrame, held, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, shard, doc_id, score, exact: before it was rounded): each shard's best k for every query of the block."""

    def run(batches):
        import pyarrow as pa

        q = held.value
        floors = q.floors.copy()  # raised by what this task's shards have given
        kinds = (np.int64, np.int64, np.uint64, np.int32, np.uint16, np.int32)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*(np.frombuffer(batch.column(c + 1)[row].as_buffer(), t) for c, t in enumerate(kinds)), q, k1, b)
                number = batch.column(0)[row].as_py()
                for at in range(0, len(q.ids), SLICE):
                    out = shard.tops([q.terms[q.limits[n] : q.limits[n + 1]] for n in range(at, min(at + SLICE, len(q.ids)))], k, floors[at : at + SLICE])
                    ids = np.repeat(q.ids[at : at + SLICE], [len(o[1]) for o in out])
                    doc, score, exact = (np.concatenate([o[c] for o in out]) for c in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), number)), pa.array(shard.ids[doc]), pa.array(score), pa.array(exact)], ["query_id", "shard", "doc_id", "score", "exact"])

    return made.select("shard", "ids", "lengths", "terms", "df", "doc", "count").mapInArrow(run, "query_id long, shard long, doc_id long, score double, exact double")


def best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The best k hits of each query (and group), with their rank."""
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_tops(made: DataFrame, shards: int, part: Queries, k: int, k1: float, b: float, at: str) -> None:
    """Writes hits of a block of queries that hold its best k to the folder: those of some
    shards, then of the others those that reach what the first have between them."""
    sc = made.sparkSession.sparkContext
    root = max(1, math.isqrt(shards))
    first = [r["shard"] for r in made.select("shard").orderBy(F.xxhash64("shard")).limit(root).collect()]
    for turn, some in enumerate((F.col("shard").isin(first), ~F.col("shard").isin(first))):
        held = sc.broadcast(part)
        hits = shard_tops(made.where(some), held, k, k1, b).withColumn("group", F.pmod(F.xxhash64("shard", F.lit(1)), F.lit(root)))
        found = saved(best(hits, k, "group").select("query_id", "doc_id", "score", "exact"), at=f"{at}/turn={turn}")
        held.destroy()
        if not turn:
            kth = best(found, k).where(F.col("rank") == k).select("query_id", "score").toPandas()  # a row a query of the block
            part.floors[np.searchsorted(part.ids, kth["query_id"])] = kth["score"]


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, terms (distinct, hashed)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, to in slices(batch.column(1), SLICE, 4 << 20):
                part = batch.slice(at, to - at)
                text, terms, _, n = term_counts(part.column(1))
                ends = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms.view(np.int64)))], ["query_id", "terms"])

    return queries.select(F.col("query_id").cast("long"), "text").mapInArrow(run, "query_id long, terms array<long>")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, rank (from 1), doc_id, score, for queries (query_id, text)."""
    spark = docs.sparkSession
    made = saved(index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), spread=True)
    n, words, shards = made.agg(F.sum("docs"), F.sum("words"), F.count("*")).first()
    q = query_terms(queries.where("query_id is not null"))
    q = saved(q.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms")))
    terms = q.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-terms // BLOCK_TERMS))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    hits = scratch(spark)
    for block in range(blocks):
        rows = q.where(F.col("block") == block).select("query_id", "terms").orderBy("query_id").toPandas()  # about BLOCK_TERMS terms
        part = Queries(rows["query_id"].to_numpy(np.int64), [np.asarray(t, np.int64).view(np.uint64) for t in rows["terms"]])
        held = spark.sparkContext.broadcast(part)
        counts = frequencies(made, held).toPandas()  # the block's terms at most
        held.destroy()
        df = np.zeros(len(part.vocabulary))
        df[counts["place"]] = counts["df"]
        part.idf, part.mean = np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5)), max((words or 0) / max(n or 0, 1), 1e-9)
        block_tops(made, shards, part, k, k1, b, f"{hits}/block={block}")
    ranked = best(spark.read.schema("query_id long, doc_id long, score double, exact double").parquet(hits), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") < int(_LAST), F.col("doc_id")).alias("doc_id"), F.round("exact", 6).alias("score"))


def op1_bm25(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP1_SQL = f"""
WITH w AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
idf AS (SELECT term, ln(1 + (st.n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, st GROUP BY term, st.n),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(idf.idf * d.tf * {K1 + 1}::DOUBLE / (d.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl.dl / st.mean))) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN idf ON idf.term = q.term JOIN dl ON dl.doc_id = d.doc_id, st
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {K}
"""
