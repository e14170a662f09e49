"""BPE in DataFrame functions against the tokenizer file's own library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagespring import plans
from pagespring.operators import tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(PATH)
    held.encode_special_tokens = True
    return lambda text: held.encode(text or "", add_special_tokens=False).ids


def test_all_documents(spark, data, plain):
    got = {r["doc_id"]: (r["n_ids"], r["ids_sha256"]) for r in plans.QUERIES["native_token_ids"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = plain(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_awkward_texts(spark, plain, monkeypatch):
    monkeypatch.setattr(tokenizing, "FREQUENT", 3)  # most pieces meet in the shuffle
    rng = random.Random(5)
    parts = ["'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "\u0085", "é", "é", "漢字", "😀", "٣", "½", "_", "!!", "<|endoftext|>", "Hello", "the", "aaaa", "-", "\x00", "﻿", "\U0001f468‍\U0001f469"]
    texts = ["", None, " ", "a", "'", "<|endoftext|>", "x" * 300, "ab" * 900 + " end", "=" * 256, "é" * 200, " " * 700 + "x"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += texts[:20]
    rows = [(k % 100 if k % 7 else None, t, 1) for k, t in enumerate(texts)]
    got = tokenizing.tokenized(spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5), PATH).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order((r["doc_id"], r["ids"]) for r in got) == order((k, plain(t)) for k, t, _ in rows)


def test_main_path_has_no_python_for_short_pieces(spark):
    words = spark.createDataFrame([("hello",)], "piece string")
    plan = words.select(tokenizing.piece_ids(F.col("piece"), PATH))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "ArrowEvalPython" not in plan


def test_empty_table(spark):
    assert tokenizing.tokenized(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
