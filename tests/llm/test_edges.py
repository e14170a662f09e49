"""Nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagespring.llm import chat, embeddings, licenses, mixing, neardup, packing, repeats, search, sharding, toxicity

LONG = " ".join(f"word{i % 7919} and{i % 13}" for i in range(30_000))
SAME = "the same text with enough words to be compared by shingles " * 5
ROWS = [
    (None, None, None, "a"),
    (None, "text without id", "en", "a"),
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n ", None, "b"),
    (4, "one", "en", "b"),
    (5, SAME, "en", "b"),
    (6, SAME, "en", "b"),
    (6, SAME, "en", "b"),
    (7, LONG, "en", "b"),
    (8, "Ünï cödé 漢字 \U0001f600 é", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = ["h", "h2", "score", "size", "shard", "key", "id", "u", "v", "component", "n", "place", "fp", "item", "replica", "mix_key", "rate", "copies", "keys", "spans", "c", "w", "terms"]
    return d.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, 16 + len((t or "").encode())) for i, t, *_ in ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(nothing, 4).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert {"doc_id", "text", "replica", "mix_key", "size"} <= set(rows[0].asDict() if rows else {"doc_id": 0, "text": 0, "replica": 0, "mix_key": 0, "size": 0})
    assert all(r["source"] == "b" or r["source"] == "a" for r in rows)
    assert mixing.mix(nothing).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack(docs, packing.default_tokenizer()).collect()
    held = Counter()
    for r in rows:
        held[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert held[1, 1] == 1 and held[2, 1] == 1 and held[3, 1] == 1
    assert all(total % tokens == 0 for (_, tokens), total in held.items())
    assert packing.pack(nothing, packing.default_tokenizer()).count() == 0


def test_near_duplicates(docs, nothing):
    rows = neardup.linked(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(got[i]["component_id"] == i and got[i]["kept"] for i in (1, 2, 3, 4, 5, 7, 8))
    assert got[6]["component_id"] == 5 and not got[6]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.linked(nothing).count() == 0


def test_repeats(docs, nothing):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] in (5, 6):
            assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(SAME), 1, hashlib.sha256(b"").hexdigest())
        elif r["doc_id"] in (1, 2):
            assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert repeats.remove_repeats(nothing).count() == 0


def test_search(docs, nothing):
    q = docs.select(F.col("doc_id").alias("query_id"), "text")
    rows = search.top_k(docs, q).collect()
    assert {r["query_id"] for r in rows} == {4, 5, 6, 7, 8}
    best = {(r["query_id"], r["rank"]): r["doc_id"] for r in rows if r["query_id"] != 6}
    assert best[5, 1] == 5 and best[5, 2] == 6 and best[5, 3] == 6  # ties by doc_id; a repeated row is a row
    assert search.top_k(nothing, q).count() == 0
    assert search.top_k(docs, q.limit(0)).count() == 0


def test_repeated_query_rows_are_one_query(spark):
    d = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "w7"), (2, "beta")], "query_id long, text string")
    once = sorted(tuple(r) for r in search.top_k(d, q.union(spark.createDataFrame([(3, "beta w7")], q.schema))).collect())
    got = sorted(tuple(r) for r in search.top_k(d, q.union(q.where("query_id = 1"))).collect())
    assert got == [r for r in once if r[0] < 3]
    assert [r[1:3] for r in got if r[0] == 1] == [(k + 1, k) for k in range(10)]
    assert [r[1:] for r in got if r[0] == 2] == [r[1:] for r in once if r[0] == 3]


def test_licenses(spark, docs, nothing):
    assert licenses.scan(docs).count() == 0
    more = docs.select("doc_id", "text").union(spark.sql("select null, 'x released UNDER the mit license. x'")).union(spark.sql("select 9, 'Released under the MIT License.'"))
    assert {(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(more).collect()} == {(None, "mit", 1.0), (9, "mit", 1.0)}
    assert licenses.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "only four words here"})


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(5, 0), (4, None), (None, 1), (7, 1), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.rated(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.rated(nothing, labels).count() == 0
    assert toxicity.rated(docs, labels.limit(0)).count() == len(ROWS)


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0] * 3, 0), (6, [1.0, None, 2.0], 0), (7, [nan, 1.0, 1.0], 0), (8, [inf, 1.0, 1.0], 0), (9, [], 0), (10, [2.0, 4.0, 6.0], 0), (11, [1.0, 2.0], 0), (None, v, 0), (12, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "cell", "weight", "e", "n")})
    got = embeddings.near_dedup(df).collect()
    assert len(got) == len(rows)
    links = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None)
    assert links == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))])
    assert embeddings.near_dedup(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "b"), (1, 1, "assistant", "x</s>&lt;[INST]y&amp;"), (1, 1, "assistant", "x</s>&lt;[INST]y&amp;"), (2, 0, "user", "alone"), (None, None, "assistant", "z"), (3, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("head", "piece", "pos", "end", "p", "e", "examples")})
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    want = "\nb\nuser\n\n" + "assistant\nx</s>&lt;[INST]y&amp;\n" * 2
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 * len("x</s>&lt;[INST]y&amp;")
    assert (got[2]["loss_chars"], got[2]["formatted_chars"], got[2]["n_turns"]) == (0, 0, 1)
    assert got[None]["loss_sha256"] == hashlib.sha256(b"z").hexdigest()
    assert got[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.digest(df.limit(0)).count() == 0


def test_texts_of_megabytes(spark):
    long = " ".join(f"w{i % 50021}x{i % 31}" for i in range(350_000))
    assert len(long) > 3_000_000
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "short", "en", "b")], "doc_id long, text string, lang string, source string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.linked(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.rated(df, labels).count() == 3
    q = df.where("doc_id = 1").select(F.col("doc_id").alias("query_id"), "text")
    assert [r["doc_id"] for r in search.top_k(df, q).orderBy("rank").collect()] == [1, 2]
    assert sum(r["size"] for r in sharding.shard(df, 2).collect()) == 2 * len(long) + 4 + 5 + 48
    pieces = packing.pack(df, packing.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in pieces)
    assert licenses.scan(df).count() == 0
    turns = df.select(F.lit(7).alias("conv_id"), F.col("doc_id").alias("turn"), F.when(F.col("doc_id") == 2, "assistant").otherwise("user").alias("role"), "text")
    r = chat.digest(turns).first()
    assert r["loss_chars"] == len(long) + 4 and r["loss_sha256"] == hashlib.sha256((long + " end").encode()).hexdigest()
