"""From page images to Markdown with stand-ins that read pixels; decoding; tokenizers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespring.functions import linework, resample
from pagespring.functions import tokens as tk
from pagespring.operators import raster
from pagespring.sources import backends as bk
from pagespring.sources import decoding as dc
from pagespring.sources import files as fl
from pagespring.sources import tokenizers as tz

from test_sources import png


def page(seed, h=120, w=300, lines=3):
    """A gray page with dark bars for text lines."""
    rng = np.random.default_rng(seed)
    g = rng.integers(238, 243, (h, w))
    for k in range(lines):
        top = 12 + k * (h // 4)
        bar = g[top : top + 14, 20 : w - 20]
        bar[:] = np.where(rng.random(bar.shape) < 0.6, 20, 240)
    return g


def digest(x):
    return hashlib.md5(np.ascontiguousarray(x, np.float32).tobytes()).hexdigest()[:8]


@pytest.fixture
def marked():
    class Marked:  # in a function, so that it is shipped with its code
        """A recogniser that puts markers on pages; the confidence goes by the page's shape."""

        def recognise(self, pixels, patches):
            import hashlib

            assert pixels.ndim == 4 and pixels.shape[2:] == (patches[0] * 14, patches[1] * 14)
            names = [hashlib.md5(p.tobytes()).hexdigest()[:8] for p in pixels]
            return [(f"see ![image](image_1.png) 100,100,600,900 and ![image](image_2.png) 5,5,5,5 {n}", 0.1 + 0.5 * (patches[0] > 60)) for n in names]

    return Marked


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k, (h, w) in enumerate([(120, 300), (120, 300), (200, 150)]):
        (tmp_path / "in" / f"p{k}.png").write_bytes(png(page(k, h, w)))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    (tmp_path / "in" / "note.txt").write_text("x")
    return str(tmp_path / "in")


def rgb(k):
    g = page(k, *[(120, 300), (120, 300), (200, 150)][k]).astype(np.uint8)
    return np.repeat(g[:, :, None], 3, 2)


def test_images_to_markdown(spark, folder, tmp_path, marked):
    images = fl.decoded_pages(spark, folder)
    assert {(r["name"], r["status"]) for r in images.collect()} == {("p0.png", "ok"), ("p1.png", "ok"), ("p2.png", "ok"), ("bad.png", "failed")}
    seen, metrics = fl.observed(bk.recognise_images(images, marked), "recognised")
    rows = {r["name"]: r for r in seen.collect()}
    assert metrics.get["rows"] == 4 and metrics.get["failed"] == 1 and metrics.get["chars"] > 0
    assert (rows["bad.png"]["status"], rows["bad.png"]["error"]) == ("failed", "the image cannot be decoded")
    done = bk.caption_images(bk.recognise_images(images, marked).where("status = 'ok'"), images, bk.StubImageCaptioner)
    out = fl.export_markdown(done, str(tmp_path / "out")).collect()
    assert sorted(r["status"] for r in out) == ["ok"] * 3
    for k in range(3):
        image = rgb(k)
        h, w = image.shape[:2]
        x, _, _ = resample.recogniser_input(image)
        at = [int(np.float32(np.float32(v) / np.float32(1000)) * np.float32(n)) for v, n in ((100, w), (600, w), (100, h), (900, h))]
        crop = image[at[2] : at[3], at[0] : at[1]]
        want = f"see [figure {digest(resample.captioner_input(crop))}] and ![image](image_2.png) 5,5,5,5 {digest(x)}"
        assert (tmp_path / "out" / f"p{k}.png.md").read_text() == want


def test_lines_in_numpy_are_the_relations(spark):
    for seed, h, w in ((1, 120, 300), (2, 60, 90), (3, 9, 130), (4, 130, 1300)):
        g = page(seed, h, w, lines=2 if h > 50 else 0)
        df = spark.createDataFrame([(0, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(g)] if h * w < 40_000 else [], "page_id long, y int, x int, gray int")
        if h * w < 40_000:
            want = [(r["y1"], r["y2"]) for r in raster.segment_lines(df).orderBy("line_idx").collect()]
            assert linework.line_spans(g) == want
            marked = {(r["y"], r["x"]) for r in raster.adaptive_threshold(df).where("value > 0").collect()}
            assert marked == set(zip(*(a.tolist() for a in np.nonzero(linework.foreground(g))), strict=True))
        else:
            assert len(linework.line_spans(g)) == 2


def test_handwriting_end_to_end(spark, folder, marked):
    images = fl.decoded_pages(spark, folder)
    lines = bk.line_images(images)
    assert {(r["name"], r["n"]) for r in lines.groupBy("name").agg(F.count("*").alias("n")).collect()} == {("p0.png", 3), ("p1.png", 3), ("p2.png", 3)}
    read = {r["name"]: r["text"] for r in bk.read_line_images(lines, bk.StubImageLineReader).collect()}
    image = rgb(0)
    spans = linework.line_spans(resample.gray_of(image))
    assert read["p0.png"] == "\n".join(f"line {digest(resample.line_input(image[a:b]))}" for a, b in spans)
    seen = bk.recognise_images(images, marked)
    again = {r["name"]: r["text"] for r in bk.with_handwriting(seen, images, bk.StubImageLineReader).collect()}
    first = {r["name"]: (r["text"], r["confidence"]) for r in seen.collect()}
    assert any(c and c > 0.28 for _, c in first.values()) and any(c and c < 0.28 for _, c in first.values())
    for name, (text, confidence) in first.items():
        assert again[name] == (read[name] if confidence and confidence > 0.28 else text)


def test_failures_stay_their_rows(spark, folder, marked):
    class Touchy:
        def recognise(self, pixels, patches):
            if len(pixels) > 1 or patches[0] > 60:
                raise ValueError("too large")
            return [("one", 0.5)]

    class Broken:
        def caption(self, prompt, pixels):
            raise RuntimeError("no caption")

    images = fl.decoded_pages(spark, folder)
    seen = {r["name"]: (r["status"], r["error"]) for r in bk.recognise_images(images, Touchy).collect()}
    assert seen["p0.png"] == ("ok", None) and seen["p2.png"] == ("failed", "too large")
    rows = bk.recognise_images(images, marked).where("status = 'ok'")
    told = {r["name"]: r for r in bk.caption_images(rows, images, Broken).collect()}
    assert all(r["status"] == "failed" and r["error"] == "no caption" and r["processed_output"].startswith("see ![image]") for r in told.values())
    assert bk.caption_images(rows.limit(0), images, Broken).count() == 0
    nulls = rows.withColumn("text", F.lit(None).cast("string")).withColumn("regions", F.lit(None).cast(dict(rows.dtypes)["regions"]))
    assert {r["processed_output"] for r in bk.caption_images(nulls, images, Broken).collect()} == {None}


def test_names_and_missing_folders(spark, tmp_path):
    gone = str(tmp_path / "nothing")
    assert fl.scan_pages(spark, gone).count() == fl.scan_documents(spark, gone).count() == fl.decoded_pages(spark, gone).count() == fl.count_files(spark, gone) == 0
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "z")], "name string, processed_output string")
    got = {(r["path"] and r["path"].rsplit("/", 1)[1], r["status"]) for r in fl.export_markdown(rows, str(tmp_path / "out")).collect()}
    assert got == {("a.md", "failed"), ("b.md", "ok"), (None, "failed")}
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["b.md"]
    a = fl.staging_folder(spark, str(tmp_path / "stage"), "1")
    (tmp_path / "stage" / "run-1" / "x").write_text("x")
    (tmp_path / "stage" / "kept").write_text("x")
    assert fl.staging_folder(spark, str(tmp_path / "stage"), "1") == a
    assert sorted(p.name for p in (tmp_path / "stage").iterdir()) == ["kept", "run-1"] and not list((tmp_path / "stage" / "run-1").iterdir())


def test_one_document(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"two")
    assert [r["name"] for r in fl.rasterised(spark, str(tmp_path / "a.pdf"), lambda n, c: [c, c]).collect()] == ["a.pdf-1.png", "a.pdf-2.png"]
    with pytest.raises(Exception, match="not rasterised"):
        fl.rasterised(spark, str(tmp_path / "a.pdf"), lambda n, c: 1 / 0).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        fl.rasterised(spark, str(tmp_path / "b.pdf"), lambda n, c: [])


TABLE = [[((t * t + j * j + t * j * 7 + 3) % 23 - 8) / 2.0 for j in range(16)] for t in range(16)]


def test_decoding_matches_the_fold(spark):
    rules = dc.Rules(limit=12, end=9, penalty=1.1, window=4, barred=(0, 4))
    prompts = spark.createDataFrame([(i, [i % 16, i // 16 % 16]) for i in range(256)] + [(999, [])], "id long, prompt array<bigint>")
    got = {r["id"]: r for r in dc.decode(prompts, lambda: dc.TableModel(TABLE), rules).collect()}
    assert (got[999]["status"], got[999]["error"]) == ("failed", "empty prompt")
    logits = F.array(*[F.array(*[F.lit(x) for x in row]) for row in TABLE])
    fold = prompts.where("id < 999").select("id", "prompt", tk.greedy(F.col("prompt"), logits, limit=12, end=9, window=4, barred=(0, 4)).alias("tokens"))
    for r in fold.collect():
        assert r["prompt"] + got[r["id"]]["tokens"] == r["tokens"]
    assert len({len(r["tokens"] or ()) for r in got.values()}) > 3


def test_stop_rules():
    model = dc.TableModel(np.eye(6)[[1, 2, 3, 4, 5, 0]])
    assert dc.generate(model, [0], dc.Rules(limit=4))[0] == [1, 2, 3, 4]
    assert dc.generate(model, [0], dc.Rules(limit=40, suffix=(2, 3)))[0] == [1, 2, 3]
    tokens, sure = dc.generate(model, [3], dc.Rules(limit=9, end=5))
    assert tokens == [4, 5] and sure == [pytest.approx(math.e / (math.e + 5))] * 2
    assert dc.chosen(np.array([np.nan, 2.0, 2.0])) == (1, 0.5) and dc.chosen(np.array([np.nan])) == (0, 0.0)
    assert dc.device(True, True) == ("cuda", "bfloat16") and dc.device(False, True)[0] == "metal" and dc.device(False, False)[0] == "cpu"
    assert dc.model_profile(1, 2).taskResources["gpu"].amount == 1


def test_tokens_and_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    held = Tokenizer.from_file(path)
    texts = ["Hello world", "", None, "漢字 and é 😀", "a\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("ids", tz.token_ids(F.col("text"), path))
    rows = df.select("text", "ids", tz.token_text(F.col("ids"), path).alias("back"), tz.streamed_text(F.col("ids"), path).alias("stream")).orderBy("id").collect()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else held.encode(r["text"], add_special_tokens=False).ids) and r["back"] == r["text"]
    assert rows[0]["stream"] == "Hello world" and rows[3]["stream"] != rows[3]["text"] and "�" in rows[3]["stream"]
    words = spark.createDataFrame([("Hello",), (None,)], "w string")
    assert [r[0] for r in words.select(tz.vocabulary_id(F.col("w"), path)).collect()] == [held.token_to_id("Hello"), None]
    with pytest.raises(Exception, match="not in the vocabulary"):
        words.select(tz.vocabulary_id(F.concat("w", F.lit(" no such entry")), path)).collect()


def test_lookup_of_a_missing_word_is_an_error(spark):
    m = F.create_map(F.lit("a"), F.lit(1))
    assert spark.range(1).select(tk.looked_up(m, F.lit("a"))).first()[0] == 1
    with pytest.raises(Exception, match="not in the vocabulary: b"):
        spark.range(1).select(tk.looked_up(m, F.lit("b"))).collect()
