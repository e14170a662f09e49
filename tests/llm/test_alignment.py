"""Alignment against a plain version that encodes whole texts and looks at every offset."""

import hashlib
import json
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespring.llm import alignment as al
from pagespring.llm.shingles import flat

ODD = ["a b", " a", "a ", "  a  b  ", "a\n b", "a\n  b \t c", "<|endoftext|> x <s> </s>", "▁a ▁", "x  y", "x　 y", "日本語 テキスト 漢字", "é é ñ", "😀 😀😀 a😀", "don't I'll 's 't", "\x00 a\x00 b", "a\r\n b", "1234 5 67", "", " ", "  ", "\n", "﻿ a", "a\u0085 b", "İ ı ſ", "<0x41> a"]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    table = {}  # the usual table between bytes and characters, by its rule
    spare = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            table[chr(x)] = x
        else:
            table[chr(spare)] = x
            spare += 1

    def one(text):
        """n_a, n_b, groups as lists of ids, links, overlaps."""
        none = (0, 0, [], [], [])
        if not text:
            return none
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        in_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        in_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode()
        if b"".join(in_a) != want or b"".join(in_b) != want:
            return none
        own_a = [k for k, t in enumerate(in_a) for _ in t]
        own_b = [k for k, t in enumerate(in_b) for _ in t]
        groups, links, over, left_a, left_b = [], [], [], [], []
        for p in range(len(want)):
            last = p + 1 == len(want)
            if p == 0 or own_a[p] != own_a[p - 1]:
                left_a.append(ids_a[own_a[p]])
            if p == 0 or own_b[p] != own_b[p - 1]:
                left_b.append(ids_b[own_b[p]])
            if not over or over[-1] != (own_a[p], own_b[p]):
                over.append((own_a[p], own_b[p]))
            if last or own_a[p + 1] != own_a[p] and own_b[p + 1] != own_b[p]:
                groups.append((left_a, left_b))
                links.append((ids_a[own_a[p]], ids_b[own_b[p]]))
                left_a, left_b = [], []
        return len(ids_a), len(ids_b), groups, links, over

    return one


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def packed(links):
    return [a << 32 | b for a, b in links]


def done(aligner, texts):
    raw, ends = flat(pa.array(texts, pa.large_string()))
    return al.texts(aligner, raw, ends, True)


def same(found, want):
    n_a, n_b, groups, links, over = want
    assert (found["n_a"], found["n_b"], found["n_groups"]) == (n_a, n_b, len(groups))
    assert found["digest"] == digest(groups)
    assert found["links"].tolist() == packed(links)
    assert list(zip(found["over_a"].tolist(), found["over_b"].tolist(), strict=True)) == over


def test_odd_and_random_texts(paths, plain):
    aligner, rng = al.Aligner.get(*paths), random.Random(4)
    chars = "ab é日😀 \n\t  .,'’ 　<>|▁0x1‍́\x00"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, found in zip(texts, done(aligner, texts), strict=True):
        same(found, plain(text))


def test_pieces_of_a_long_text(paths, plain, monkeypatch):
    monkeypatch.setattr(al, "PART", 50)
    aligner, rng = al.Aligner.get(*paths), random.Random(9)
    for _ in range(30):
        text = "".join(rng.choice(["word ", "日本 ", "a  b", "\n", "  ", "x" * 90, "tail "]) for _ in range(60))
        same(done(aligner, [text])[0], plain(text))


def test_a_text_whose_units_are_odd_is_looked_at_whole(paths, plain):
    aligner = al.Aligner.get(*paths)
    text = "some words stand here"
    raw, ends = flat(pa.array([text], pa.large_string()))
    s, e, at = aligner.units(raw, ends)
    same(al.odd_text(aligner, raw, aligner.slots(raw, s, e)), plain(text))


def test_a_worker_that_forgets(paths, plain, monkeypatch):
    monkeypatch.setattr(al, "UNITS_KEPT", 5)
    aligner = al.Aligner.get(*paths)
    for k in range(40):
        text = f"word{k} again and word{k + 1}"
        same(done(aligner, [text])[0], plain(text))
        aligner.rest()


def check(rows, texts, plain):
    """Rows (doc_id, ...) against a plain count over the whole table of (doc_id, text)."""
    each = [(i, plain(t)) for i, t in texts]
    count = Counter(x for _, (*_, links, _) in each for x in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = Counter(
        (i, n_a, n_b, len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest(g)) for i, (n_a, n_b, g, links, _) in each
    )
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)
    assert got == want


def test_query_against_a_plain_version(spark, data, plain):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    check(al.op11_align(spark, data).collect(), [(r["doc_id"], r["text"]) for r in docs], plain)


@pytest.mark.parametrize("pairs", [1 << 22, 40])
def test_edges_and_blocks_of_counts(spark, paths, plain, monkeypatch, pairs):
    monkeypatch.setattr(al, "PAIRS", pairs)
    texts = [(None, None), (None, "no id here"), (1, None), (2, ""), *((3, t) for t in ODD), (4, "same same"), (4, "same same"), (5, "word " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("row", "links", "pair", "n", "b", "best", "n_a")})
    check(al.alignment(docs, *paths).collect(), texts, plain)
    assert al.alignment(docs.limit(0), *paths).count() == 0


def test_full_output(spark, paths, plain):
    docs = spark.createDataFrame([(1, "The tokens differ, don't they?"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in al.aligned(docs, *paths, full=True).collect()}
    n_a, n_b, groups, _, over = plain("The tokens differ, don't they?")
    r, i, j, got = rows[1], 0, 0, []
    for x, y in zip(r["cut_a"], r["cut_b"], strict=True):
        got.append((r["a_ids"][i : x + 1], r["b_ids"][j : y + 1]))
        i, j = x + 1, y + 1
    assert got == groups and (len(r["a_ids"]), len(r["b_ids"])) == (n_a, n_b)
    assert list(zip(r["over_a"], r["over_b"], strict=True)) == over
    assert rows[2]["a_ids"] == [] and rows[2]["groups_sha256"] == ""


def test_what_is_kept_stays_within_bounds(paths, monkeypatch):
    """Units are forgotten and learnt again in the same memory; cuts and overlaps only if asked for."""
    monkeypatch.setattr(al, "UNITS_KEPT", 300)
    slim, whole, rng = al.Aligner(*paths, full=False), al.Aligner(*paths), random.Random(12)
    held, sizes = ("ids_a", "ids_b", "link", "text"), set()
    for _ in range(40):
        raws = [" ".join(f"w{rng.randrange(10**6)}é" for _ in range(rng.randint(0, 60))).encode() for _ in range(8)]
        raw, ends = np.frombuffer(b"".join(raws), np.uint8), al.limits_of(np.array([len(r) for r in raws]))
        got, want = al.texts(slim, raw, ends, False), al.texts(whole, raw, ends, True)
        for x, y in zip(got, want, strict=True):
            assert all(np.array_equal(x[k], y[k]) for k in ("n_a", "n_b", "n_groups", "digest", "links"))
        assert not slim.cut_a.used and not slim.over_a.used
        slim.rest()
        sizes.add(tuple(id(getattr(slim, k)) for k in held))
    assert len(sizes) == 1 and slim.ids_a.rows <= 300 and len(slim.ids_a.starts) <= 1 << 10


WORKER = """
import json, random, re, sys
import numpy as np
from pagespring.llm import alignment as al

def held(name):
    return int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read()).group(1))

aligner, rng = al.Aligner(*sys.argv[1:], full=False), random.Random(5)
before = held("RssAnon")
for _ in range(6):
    raws = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(60)).encode() for _ in range(1000)]
    ends = al.limits_of(np.array([len(r) for r in raws]))
    raw, at = np.frombuffer(b"".join(raws), np.uint8), 0
    while at < len(raws):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + al.PART, "right")) - 1)
        al.texts(aligner, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at], False)
        aligner.rest()
        at = to
print(json.dumps([held("Threads"), (held("RssAnon") - before) >> 10]))
"""


def test_a_worker_stays_small(paths):
    """360,000 distinct units: one thread, as a task has one core, and bounded memory."""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"OMP_NUM_THREADS": "1", "PYTHONPATH": str(Path(al.__file__).parents[2])}
    out = subprocess.run([sys.executable, "-c", WORKER, *paths], env=env, capture_output=True, text=True, check=True).stdout
    threads, grown = json.loads(out)
    assert threads == 1 and grown < 250, (threads, grown)
