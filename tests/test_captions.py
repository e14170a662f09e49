"""Captions in full batches against the fold that asks for one after the other."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagespring.functions.captions import Failed, Fold, pooled
from pagespring.functions.prompts import prompt
from pagespring.sources import backends as bk


def label(k, *v):
    return f"![image](image_{k}.png) {','.join(map(str, v))}"


def told(prompt_, label_):
    """Captions of many lengths; some hold a later label, or nothing."""
    h = hashlib.md5((prompt_ + label_).encode()).hexdigest()
    return ["", f"[{h[:6]}]", h * 12, f"see {label(2, 1, 2, 3, 4)} {h[:3]}", f"{h[:4]} ![image](image_"][int(h[0], 16) % 5]


def sequential(text, labels, kept=(), fails=lambda p, x: False):
    """(text, error, calls): the plain fold."""
    calls = []
    for k, x in enumerate(labels):
        if x in text and k not in kept:
            p = prompt(text)
            calls.append((p, x))
            if fails(p, x):
                return text, "no caption", calls
            text = text.replace(x, told(p, x))
    return text, None, calls


def pages(rng, n):
    out = []
    for name in range(n):
        pool = [label(k % 4, *(rng.choice([1, 12, 123]) for _ in range(4))) for k in range(rng.randint(0, 9))]
        pool += [x + "5" for x in pool[:2]] + pool[:1]
        rng.shuffle(pool)
        text = ""
        for x in pool:
            text += "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 40, 350]))) + x
        kept = [k for k in range(len(pool)) if rng.random() < 0.1]
        out.append((name, text, pool, kept))
    return out


@pytest.mark.parametrize("batch", [1, 3, 16])
def test_pool_matches_the_fold(batch):
    rng = random.Random(batch)
    some = pages(rng, 200)
    asked, sizes = [], []

    def call(items):
        sizes.append(len(items))
        asked.extend(items)
        return [(told(p, x), None) for p, x in items]

    got = dict(pooled(((n, Fold(t, ls, kept), ls) for n, t, ls, kept in some), call, batch))
    want = {n: sequential(t, ls, kept) for n, t, ls, kept in some}
    assert {n: (f.text, f.error) for n, f in got.items()} == {n: w[:2] for n, w in want.items()}
    # the same calls, in other batches
    assert sorted(asked) == sorted(c for w in want.values() for c in w[2])
    assert sum(s == batch for s in sizes) >= 0.9 * len(sizes) and max(sizes) <= batch


def test_levels_are_few_where_labels_stand_far_apart():
    text = "x" * 400 + "".join(label(k, 1, 1, k, k) + " " for k in range(50))
    fold = Fold(text, [label(k, 1, 1, k, k) for k in range(50)])
    assert len(fold.ready()) == 50 and fold.ready() == []
    near = Fold(text[400:], fold.labels)
    assert len(near.ready()) == 1


def test_failures_and_noncharacters():
    rng = random.Random(77)
    some = pages(rng, 150) + [(900, "\U0010ffff " + label(1, 1, 2, 3, 4) + label(2, 1, 2, 3, 4), [label(1, 1, 2, 3, 4), label(2, 1, 2, 3, 4)], [])]

    def fails(p, x):
        return hashlib.md5((x + p).encode()).digest()[0] % 6 == 0

    def call(items):
        return [(None, "no caption") if fails(p, x) else (told(p, x), None) for p, x in items]

    got = dict(pooled(((n, Fold(t, ls, kept), ls) for n, t, ls, kept in some), call, 8))
    for n, t, ls, kept in some:
        assert (got[n].text, got[n].error) == sequential(t, ls, kept, fails)[:2]
    assert isinstance(Failed("x"), str)


def test_frames(spark):
    class Counted:
        def captions(self, prompts, labels):
            if len(labels) > 1 and any("image_3" in x for x in labels):
                raise ValueError("not together")
            if "image_3" in labels[0]:
                raise ValueError("not at all")
            return [f"<{len(p)} {x[9:16]}>" for p, x in zip(prompts, labels, strict=True)]

    def text(k):
        return f"{k} " + "y" * (k * 37 % 500) + label(k % 4, k, 2, 30, 40) + " and " + label(5, 7, 8, 9, 10)

    rows = spark.createDataFrame([(f"p{k}", text(k)) for k in range(60)] + [("none", "plain"), ("null", None), ("p1", text(1))], "name string, text string")
    found = bk.regions(F.col("text"), F.lit(1654), F.lit(2339))
    got = sorted((r["name"], r["processed_output"], r["status"], r["error"]) for r in bk.caption(rows.withColumn("regions", found), Counted, batch=7).where("name <> 'null'").collect())
    want = [("none", "plain", "ok", None)]
    for k in [*range(60), 1]:
        t, error = text(k), None
        for x in (label(k % 4, k, 2, 30, 40), label(5, 7, 8, 9, 10)):
            if "image_3" in x:
                error = "not at all"
                break
            t = t.replace(x, f"<{len(prompt(t))} {x[9:16]}>")
        want.append((f"p{k}", t, "failed" if error else "ok", error))
    assert got == sorted(want, key=str)


def test_a_backend_that_cannot_be_made(spark):
    def broken():
        raise RuntimeError("no weights")

    rows = spark.createDataFrame([("a", "see " + label(1, 1, 2, 3, 4)), ("b", "plain")], "name string, text string")
    rows = rows.withColumn("regions", bk.regions(F.col("text"), F.lit(10), F.lit(10)))
    got = {r["name"]: (r["status"], r["error"]) for r in bk.caption(rows, broken).collect()}
    assert got == {"a": ("failed", "no weights"), "b": ("ok", None)}


def test_full_batches_by_size(spark, tmp_path):
    """Pages of one size meet across the cluster: nearly all calls are full, and no size is hot."""
    counted = str(tmp_path)

    class Sized:
        def recognise(self, pixels, patches):
            import os
            import uuid

            assert pixels.shape[2:] == (patches[0] * 14, patches[1] * 14)
            open(os.path.join(counted, f"{len(pixels)}-{patches[0]}-{uuid.uuid4().hex}"), "w").close()
            return [("t", 0.5)] * len(pixels)

    # 90 pages, two thirds of one size, dealt over many partitions; and two that were not decoded
    rows = [(f"d/p{k}", f"p{k}", *((6, 9) if k % 3 else (9, 5)), "ok", None) for k in range(90)]
    rows = [(p, n, h, w, bytes(h * w * 3), s, e) for p, n, h, w, s, e in rows] + [(f"d/bad{k}", f"bad{k}", None, None, None, "failed", "broken") for k in range(2)]
    images = spark.createDataFrame(rows, "path string, name string, height int, width int, pixels binary, status string, error string").repartition(10)
    classes = {(r["pw"], r["ph"]): r for r in bk.size_classes(images).collect()}
    assert sorted(r["pages"] for r in classes.values()) == [30, 60]
    one = max(pw * ph * 12 for pw, ph in classes)
    ranges = bk.size_classes(images, 20 * one).collect()
    assert max(r["ranges"] for r in ranges) >= 3  # the size that most pages have is split
    dealt = bk.dealt_by_size(images, 20 * one)
    per = dealt.where("status = 'ok'").groupBy(F.spark_partition_id().alias("p"), "pw", "ph").count().collect()
    assert len({r["p"] for r in per}) == len(per) and max(r["count"] for r in per) <= 45
    got = bk.recognise_images(images, Sized, batch=6).collect()
    assert len(got) == 92 and sum(r["status"] == "ok" for r in got) == 90
    sizes = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert sum(sizes) == 90 and sum(s == 6 for s in sizes) >= 0.75 * len(sizes)


def test_line_errors_are_kept(spark):
    class Touchy:
        def read(self, pixels):
            if (pixels > 0.5).all(axis=(1, 2, 3)).any():
                raise ValueError("blank line")
            return ["ink"] * len(pixels)

    rows = [("a", 0, 0, 4, 4, 8, bytes([0] * 96)), ("a", 1, 4, 8, 4, 8, bytes([255] * 96)), ("a", 2, 8, 12, 4, 8, bytes([0] * 96))]
    lines = spark.createDataFrame(rows, bk.LINES)
    r = bk.read_line_images(lines, Touchy, batch=3).first()
    assert r["text"] == "ink\nink" and [(e["line_idx"], e["error"]) for e in r["errors"]] == [(1, "blank line")]


def test_the_stage_gets_its_profile(spark):
    from pagespring.sources import decoding as dc

    rows = spark.createDataFrame([("a", "see " + label(1, 1, 2, 3, 4))], "name string, text string")
    rows = rows.withColumn("regions", bk.regions(F.col("text"), F.lit(10), F.lit(10)))
    profile = dc.model_profile(1, 2)
    plan = bk.caption(rows, bk.StubCaptioner, profile=profile)._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan
    images = spark.createDataFrame([("d/p", "p", 6, 9, bytes(162), "ok", None)], "path string, name string, height int, width int, pixels binary, status string, error string")
    plan = bk.recognise_images(images, bk.StubImageRecogniser, profile=profile)._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan
