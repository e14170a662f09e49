"""Whitening against numpy over the whole table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespring.llm import whitening as wh


def plain(vectors):
    """n, deviations (exact), eigenvalues, whitened by every component, for vectors of one length."""
    x = [[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    deviation = [sum(c * c for c in v) for v in d]
    centred = np.array([[c / n for c in v] for v in d])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    with np.errstate(all="ignore"):
        return n, deviation, values, centred @ vectors / np.sqrt(values)


def test_query_against_numpy(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    kept = [r for r in table if r["embedding"] is not None and len(r["embedding"]) and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, values, whitened = plain([r["embedding"] for r in kept])
    rows = wh.op13_whiten(spark, data).collect()
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(8):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in kept])
        assert min(abs(mine - whitened[:, k]).max(), abs(mine + whitened[:, k]).max()) < 1e-9
        assert abs(got[kept[0]["vec_id"], k + 1]["explained"] - values[k] / values.sum()) < 1e-12
    assert [got[r["vec_id"], 1]["deviation"] for r in kept] == deviation
    (error,) = {r["identity_error"] for r in rows}
    both = np.array([[got[r["vec_id"], k + 1]["whitened"] for k in range(8)] for r in kept])
    both -= both.mean(0)
    assert error < 1e-9 and abs(both.T @ both / n - np.eye(8)).max() < 1e-9


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=3).tolist()) for k in range(20)]
    rows = [*good, (3, good[3][1]), (None, good[5][1]), (30, None), (31, []), (32, [1.0, None, 2.0]), (33, [1.0, float("nan"), 2.0]), (34, [float("inf"), 0.0, 0.0]), (35, [1e300, 0.0, 0.0])]
    rows += [(40 + k, [float(k), 1.0]) for k in range(4)] + [(50, [7.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return rows, d.withColumns({c: F.lit("clash") for c in ("x", "w", "n", "c", "at", "s", "dims", "deviation", "label")})


def test_edges(edges):
    rows, d = edges
    got = wh.whiten(d, 8).collect()
    by_length = {k: [r for r in got if len(r["w"]) == k] for k in (3, 2, 1)}
    assert {k: len(v) for k, v in by_length.items()} == {3: 22, 2: 4, 1: 1} and len(got) == 27
    three = [(i, v) for i, v in rows if v and len(v) == 3 and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    n, deviation, values, whitened = plain([v for _, v in three])
    assert sorted(r["deviation"] for r in by_length[3]) == sorted(deviation)
    assert {r["n"] for r in by_length[3]} == {n} and sum(r["vec_id"] is None for r in by_length[3]) == 1
    assert sum(r["vec_id"] == 3 for r in by_length[3]) == 2
    mine = np.array(sorted(r["w"] for r in by_length[3]))
    assert np.allclose(np.abs(mine).sum(0), np.abs(whitened).sum(0))
    # the second number of the vectors of two is the same in all, the vector of one is alone
    assert all(r["w"][0] is not None and r["w"][1] is None and r["explained"] == [1.0, 0.0] for r in by_length[2])
    assert by_length[1][0]["w"] == [None] and by_length[1][0]["identity_error"] is None and by_length[1][0]["deviation"] == 0
    assert wh.whiten(d.limit(0), 8).count() == 0
    assert len(wh.whiten(d.limit(0), 8).columns) == 6


def test_equal_rows_have_no_variance(spark):
    d = spark.createDataFrame([(k, [1.5, -2.25]) for k in range(5)], "vec_id long, embedding array<float>")
    assert all(r["w"] == [None, None] and r["deviation"] == 0 and r["explained"] == [0.0, 0.0] for r in wh.whiten(d, 2).collect())


def test_large_numbers_stay_exact(spark):
    rows = [(2**60 + k, [2.0**45 * (k + 1), 1.0 * k]) for k in range(6)] + [(None, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in wh.whiten(d, 2).collect()}
    _, deviation, _, _ = plain([v for _, v in rows])
    for (i, _), want in zip(rows, deviation, strict=True):
        assert got[i]["deviation"] == (want if want < 2**63 else None)
    assert min(deviation) >= 2**63 or len(got) == 7
