"""Decontamination against brute force over every window."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespring.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lower)


def brute(docs, items, window=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    out = []
    for d, text in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    held |= found
        held = sorted(str(i) for i in held if i is not None)
        out.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def digest(c):
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, n: a + n)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    rows = c.select("doc_id", "n_words", hit.alias("h"), F.size("items"), F.sha2(F.array_join(names, ","), 256), hit > 0).collect()
    return sorted((tuple(r) for r in rows), key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    clash = ("row", "items", "starts", "ends", "hits", "n_words", "doc", "word")
    return d.withColumns({c: F.lit("clash") for c in clash}), b.withColumns({c: F.lit("clash") for c in (*clash, "doc_id")})


def planted(seed, docs=120, items=25, vocabulary=9):
    """Texts over few words, so that windows of every kind overlap; items of 0 to 40 words."""
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice("αβγδεζηθικ"[:vocabulary]) for _ in range(n))

    bench = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(items)]
    out = []
    for k in range(docs):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(bench)[1].split()
            at = rng.randint(0, len(w))
            parts += [" ".join(w[at : at + rng.randint(1, 30)]), rng.choice(["; ", "NEW-", "unknown "]) + text(rng.randint(0, 9))]
        out.append((k, " ".join(parts)))
    return out, bench


@pytest.mark.parametrize("window", [1, 4, 10])
def test_random_texts(spark, window):
    docs, items = planted(window)
    d, b = tables(spark, docs, items)
    assert digest(dc.contamination(d, b, window)) == brute(docs, items, window)


def test_long_items_only(spark):
    docs, items = planted(7)
    items = [(i, t) for i, t in items if len(t.split()) >= 10] + [(99, docs[0][1]), (98, docs[0][1])]
    d, b = tables(spark, docs, items)
    assert digest(dc.contamination(d, b)) == brute(docs, items)


@pytest.mark.parametrize("shard,part", [(64, 100), (1 << 20, 64)])
def test_small_shards_and_pieces(monkeypatch, shard, part):
    monkeypatch.setattr(dc, "SHARD", shard)
    monkeypatch.setattr(dc, "PART", part)
    rng = random.Random(3)
    docs, items = planted(11)
    docs += [(1000 + k, " ".join(t for _, t in rng.choices(docs, k=20))) for k in range(4)]
    giant = "z" * 500
    docs += [(2000, f"{giant} " + " ".join(t for _, t in docs[:5]) + f" {giant.upper()}"), (2001, giant), (2002, "z" * 499)]
    items = [*items, (500, giant)]

    def hashes(text):
        return np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in dc.hashed_words(*dc.flat(pa.array([text], pa.large_string()))))])

    block = dc.block_of([(i, hashes(t), 0, True) for i, t in items], 10)
    waiting: list = []
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(docs)), pa.array([i for i, _ in docs]), pa.array([t for _, t in docs], pa.string())], ["row", "doc_id", "text"])
    for layout, _ in dc.shards([batch], block, waiting):
        for number, *hits in layout.found(block):
            waiting[number][3].append(hits)
    found = []
    for _, doc, n, hits in waiting:
        s, e = (np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, np.int64) for k in (0, 1))
        by = np.argsort(s, kind="stable")
        s, e = dc.joined(s[by], e[by]) if len(s) else (s, e)
        held = sorted(str(block.names[i]) for i in set().union(*(h[2].tolist() for h in hits)))
        found.append((doc, n, int((e - s).sum()), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(len(s))))
    assert sorted(found, key=str) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = planted(13)
    d, b = tables(spark, docs, items)
    monkeypatch.setattr(dc, "BLOCK", 60)  # an item of 40 words stays whole, several blocks
    assert len(list(dc.benchmark_blocks(b, 10))) > 3
    assert digest(dc.contamination(d, b)) == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK", 25)  # items of 40 words come in pieces
    assert digest(dc.contamination(d, b)) == brute(docs, items)


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(None, passage), (1, passage), (1, "another item under the same id with just enough words"), (2, None), (3, ""), (4, " .,; "), (5, "short item"), (-7, passage + " thirteen")]
    docs = [(None, passage), (None, None), (1, ""), (2, " -- "), (3, passage.upper()), (3, passage), (4, "a short item, here"), (5, "x " * 300_000 + passage), (6, "one two three"), (7, passage.replace(" ", "\x00\t")), (8, "é" + passage)]
    d, b = tables(spark, docs, items)
    want = brute(docs, items)
    assert digest(dc.contamination(d, b)) == want
    assert sorted((r["doc_id"] for r in dc.decontaminated(d, b).collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)
    assert dc.contamination(d.limit(0), b).count() == 0
    assert digest(dc.contamination(d, b.limit(0))) == brute(docs, [])


def test_longest_matches(spark):
    docs, items = planted(17)
    items = [(i, t) for i, t in items if len(t.split()) >= 10]
    d, b = tables(spark, docs, items)
    got = {(r["item_id"], r["at"]): r for r in dc.longest_matches(d, b).collect()}
    texts = {i: words(t) for i, t in docs}
    want = {}
    for i, t in items:
        w = words(t)
        for at in range(len(w) - 9):
            best = max(next((k for k in range(min(len(x) - p, len(w) - at)) if x[p + k] != w[at + k]), min(len(x) - p, len(w) - at)) for x in texts.values() for p in range(len(x) or 1))
            if best >= 10:
                want[i, at] = best
    assert {k: r["words"] for k, r in got.items()} == want
    for (i, at), r in got.items():
        assert texts[r["doc_id"]][r["doc_at"] : r["doc_at"] + r["words"]] == words(dict(items)[i])[at : at + r["words"]]


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ids = rng.integers(0, 4, rng.integers(1, 200)).astype(np.int32)
        first = np.flatnonzero(ids)
        bits, per = 2, int(rng.integers(1, 5))
        order = dc.suffix_array(ids, first, dc.packed(ids, bits, per), per, 400)

        def suffix(p, ids=ids):
            tail = ids[p:].tolist()
            return tail[: tail.index(0)] if 0 in tail else tail

        assert sorted(order.tolist()) == first.tolist()
        assert [suffix(p) for p in order] == sorted(suffix(p) for p in first)
