"""What a search reads of the index, against scoring every posting of a query's terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespring.llm import search

SF_DIR = "/root/testdata/sf0.1"
KINDS = {"ids": np.int64, "lengths": np.int64, "terms": np.uint64, "df": np.int32, "doc": np.uint16, "count": np.int32}


@pytest.fixture(scope="module")
def searched(spark):
    """The largest shard of all documents and their queries."""
    docs = search.table(spark, SF_DIR, "documents").select("doc_id", "text")
    row = search.index(docs.coalesce(1)).orderBy(F.desc("docs")).first()
    rows = search.query_terms(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")).collect()
    q = search.Queries(np.array([r[0] for r in rows]), [np.array(r[1], np.int64).view(np.uint64) for r in rows])
    arrays = {k: np.frombuffer(row[k], t) for k, t in KINDS.items()}
    place = q.places(arrays["terms"])
    df = np.zeros(len(q.vocabulary))
    df[place[place >= 0]] = arrays["df"][place >= 0]
    q.idf, q.mean = np.log(1 + (row["docs"] - df + 0.5) / (df + 0.5)), row["words"] / row["docs"]
    return search.Shard(*arrays.values(), q, search.K1, search.B), [q.terms[a:z] for a, z in zip(q.limits, q.limits[1:])]


def plain(shard, terms):
    """The best documents by all postings of the terms, and how many these are."""
    starts, sizes = shard.of[terms], shard.of[terms + 1] - shard.of[terms]
    score = np.round(shard.summed(starts, sizes), 9)
    order = np.lexsort((shard.ids, -score))[: search.K]
    return order[score[order] > 0], score[order][score[order] > 0], int(sizes.sum())


def test_bounds_and_postings_read_are_well_below_all_postings(searched):
    shard, queries = searched
    want = [plain(shard, t) for t in queries]
    every = sum(w[2] for w in want)
    for known in (False, True):  # the shard's own k-th score as threshold
        shard.bounds_read = shard.postings_read = 0
        for terms, (docs, scores, _) in zip(queries, want):
            floor = scores[-1] if known and len(scores) == search.K else 0.0
            got, score = shard.top(terms, search.K, floor)
            assert got.tolist() == docs.tolist()
            assert np.allclose(score, scores, atol=2e-9)
        assert shard.bounds_read + shard.postings_read < 0.5 * every


def test_a_cursor_reads_pivots_alone(searched):
    shard, queries = searched
    terms = max(queries, key=len)
    rows = shard.row[terms]
    rows = rows[rows >= 0]
    pivots = np.array([0, 3, len(shard.ids) - 1])
    shard.postings_read = 0
    got = shard.entered(rows, pivots)
    assert shard.postings_read <= search.STRIDE * len(pivots) * len(rows)
    frequent = np.flatnonzero(shard.row >= 0)
    of = frequent[np.isin(shard.row[frequent], rows)]
    assert np.allclose(got, shard.summed(shard.of[of], shard.of[of + 1] - shard.of[of])[pivots])


def test_a_slice_of_queries_has_its_bounds_in_one_product(searched):
    """Bounds are those of each query alone, cursors are moved for few documents, and what is
    found is the threshold of what follows."""
    shard, queries = searched
    bounds = shard.block_bounds(queries)
    for terms, row in zip(queries, bounds, strict=True):
        rows = shard.row[terms]
        assert np.allclose(row, shard.largest[rows[rows >= 0]].sum(0))
    floors = np.zeros(len(queries))
    first = shard.tops(queries, search.K, floors)
    assert floors.tolist() == [s[-1] if len(s) == search.K else 0.0 for _, s, _ in first]
    shard.blocks_met = shard.blocks_entered = 0
    again = shard.tops(queries, search.K, floors)
    assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(first, again, strict=True))
    assert shard.blocks_entered < 0.15 * shard.blocks_met


def test_scores_are_rounded_once(spark, same_as_sql):
    """One of these thousand scores is just below a half at the seventh place, and at a half if
    it is rounded to nine places first."""
    same_as_sql(search.op1_bm25(spark, SF_DIR), search.OP1_SQL, SF_DIR)
