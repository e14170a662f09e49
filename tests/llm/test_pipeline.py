"""The stages on small rows of known fate."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest

from pagespring.llm import mixing, neardup, packing, toxicity
from test_methods import brute_components


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (name, f) in enumerate(cp.STAGES):
        before = docs
        f(spark, docs, data).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append((name, before, docs))
    return out


def test_columns_and_rows(stages, spark, data):
    for _, before, after in stages[:-1]:
        assert after.columns == list(cp.COLUMNS) == before.columns
    assert cp.run(spark, data).count() == stages[-1][2].count()


def test_rejections_take_effect(stages):
    _, before, after = stages[0]
    assert 0 < before.count() - after.count() < 0.3 * before.count()
    assert after.join(before, ["doc_id", "text"]).count() == after.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    groups = {r["doc_id"]: r["component_id"] for r in neardup.linked(before, width=cp.WORDS).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(groups.values()))


def test_only_near_copies_go_where_ids_are_shared(spark, data):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, ""), (3, ""), (None, texts[3]), (None, texts[3]), (None, texts[0]), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_copies(spark, docs, data).collect()
    key = [(r["doc_id"] or 0, r["text"] or "") for r in got]
    assert sorted(key) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, ""), (0, texts[3]), (0, ""), (0, "")])


def test_repeats_are_gone(stages):
    _, before, after = stages[2]
    assert after.count() == before.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(len(left[i]) <= len(t) for i, t in texts.items())
    assert any(len(left[i]) < len(t) for i, t in texts.items())


def test_copies_of_mixed_documents_are_whole(stages):
    _, before, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in after.collect())


def test_everything_is_packed(stages):
    _, before, after = stages[4]
    whole = {(r["doc_id"], r["start"]) for r in after.collect()}
    assert {i for i, _ in whole} == {r["doc_id"] for r in before.collect()}
    totals = after.groupBy("sequence_id").sum("length").collect()
    assert all(re.fullmatch("10*", bin(r[1])[2:]) for r in totals)


# each stage against a plain version of itself, over the rows that its predecessor kept


def test_toxicity_keeps_what_scores_below(stages, spark, data):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.rated(before, labels).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, s in scores.items() if s < toxicity.REJECT)


def test_near_duplicates_by_brute_force(stages):
    _, before, after = stages[1]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], cp.WORDS, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)


def test_repeats_by_brute_force(stages):
    _, before, after = stages[2]
    rows = before.collect()
    left = {r["doc_id"]: r for r in after.collect()}
    data = [r["text"].encode() for r in rows]
    counts = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    cut = 0
    for r, t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        pieces = [t[m.start() : m.end()] for m in re.finditer(b"\0+", bytes(gone))]
        got = left[r["doc_id"]]
        assert got["text"] == "".join(p.decode(errors="ignore") for p in pieces)  # the rest of a cut character goes
        assert (got["lang"], got["source"], got["n_chars"]) == (r["lang"], r["source"], len(got["text"]))
        cut += sum(gone)
    assert cut > 1000


def test_mixing_by_brute_force(stages):
    _, before, after = stages[3]
    rows, sizes = before.collect(), Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].encode())
    weights = {k: n**mixing.ALPHA for k, n in sizes.items()}
    want = Counter()
    for r in rows:
        rate = weights[r["source"]] / sum(weights.values()) * sum(sizes.values()) / sizes[r["source"]]
        u = (int(hashlib.md5(f"{mixing.SEED}|{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, upto = 0, math.exp(-rate), math.exp(-rate)
        while u > upto:
            k += 1
            p *= rate / k
            upto += p
        if k:
            want[r["doc_id"], r["text"]] = k
    assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == want


def test_packing_by_brute_force(stages):
    _, before, after = stages[4]
    tokenizer = packing.WordTokenizer.get(packing.default_tokenizer()).tokenizer
    want = Counter((r["doc_id"], (*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID)) for r in before.collect())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in after.collect():
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == r["length"]
        pieces[r["doc_id"], r["start"], r["doc_tokens"]].append(tuple(r["ids"]))
    for own in sequences.values():
        upto = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == upto
            upto += r["length"]
        assert upto <= packing.WINDOW
    # copies of a document may be cut at different places; every id stands as often as it should
    got = Counter()
    for (i, _, _), held in pieces.items():
        for ids in held:
            got.update((i, x) for x in ids)
    assert got == Counter({(i, x): n for (i, x), n in sum((Counter({(i, x): c * k for x, c in Counter(ids).items()}) for (i, ids), k in want.items()), Counter()).items()})


def test_stages_free_what_a_worker_kept():
    """A worker that packed goes on to other stages, in the same memory."""
    from pagespring.llm import neardup, packing, repeats

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):  # the function that a task runs
            return f

    path = packing.default_tokenizer()
    for task in (neardup.signed(Docs(), 5), repeats.anchors(Docs(), 200)):
        assert packing.WordTokenizer.get(path) is packing.WordTokenizer.get(path)
        assert not list(task(iter([])))
        assert not packing.WordTokenizer._loaded
