"""Hand cases; expected values come from the operators' definitions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespring.functions import numbers as nb
from pagespring.functions import text as tx
from pagespring.functions import tokens as tk
from pagespring.functions import vectors as vc
from pagespring.operators import pages as pg
from pagespring.operators import raster as rs
from pagespring.operators import regions as rg
from pagespring.operators import sizes as sz
from pagespring.operators import tensors as tz

A, A5 = "![image](image_1.png) 1,2,3,4", "![image](image_1.png) 1,2,3,45"
B = "![image](image_2.png) 5,6,7,8"


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("plain", 0),
        (A, 1),
        ("![image](image_1.png)1,2,3,4", 1),
        ("![image](image_1.png)\n1,2,3,4", 1),
        ("![image](image_1.png) 1, 2,3,4", 0),
        ("![image](image_1.png) -1,2,3,4", 0),
        ("![image](image_x.png) 1,2,3,4", 0),
        ("![image](image_1.jpg) 1,2,3,4", 0),
        ("![image](image_1.png) 1,2,3,٤", 1),
    ],
)
def test_markers(spark, text, n):
    assert len(one(spark, rg.labels(F.col("t")), t=text)) == n


def test_marker_ends_at_digits(spark):
    assert one(spark, rg.labels(F.col("t")), t="![image](image_1.png) 1,2,3,4.5") == [A]


def test_projection_is_single_precision(spark):
    cases = [(1000, 1654, 1654), (500, 1654, 827), (250, 2339, 584), (1200, 1654, 1984), (130, 1700, 220), (260, 1700, 441), (290, 1700, 493), (195, 2200, 428), (345, 2200, 759)]
    df = spark.createDataFrame(cases, "v int, dim int, want int")
    assert [r.x for r in df.select(nb.to_pixels(F.col("v"), F.col("dim")).alias("x")).collect()] == [c[2] for c in cases]
    rng = np.random.default_rng(1)
    v, d = rng.integers(0, 5000, 3000), rng.integers(1, 5000, 3000)
    want = ((v.astype(np.float32) / np.float32(1000)) * d.astype(np.float32)).astype(np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(v, d, strict=True)], "v int, dim int")
    assert [r.x for r in df.select(nb.to_pixels(F.col("v"), F.col("dim")).alias("x")).collect()] == want.tolist()


def test_projection_saturates_and_defaults(spark):
    r = rg.regions(F.col("t"), F.lit(2000), F.lit(2000))
    found = one(spark, r, t="![image](image_1.png) 1,99999999999999,٤,4")
    assert found[0]["y1"] == nb.U32
    assert found[0]["x2"] == 0  # a digit of another script parses as 0


@pytest.mark.parametrize(("text", "want"), [("x", "x"), (f"{A} x {B}", "a x b"), (f"{A} x {A}", "a x a"), (f"{A} x {A5}", "a x a5"), (f"{A5} x {A}", "a x b")])
def test_fold_replaces_in_order(spark, text, want):
    # captions a, b, .. by how many were made; later labels may be gone already
    labels = rg.labels(F.col("t"))
    n = F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.substring(F.lit("abc"), i + 1, F.lit(1)).alias("c")))
    out = F.aggregate(n, F.col("t"), lambda acc, r: F.replace(acc, r["label"], r["c"]))
    assert one(spark, out, t=text) == want
    assert one(spark, rg.splice(F.col("t"), labels, lambda acc, label: F.lit("z")), t=text).count("z") == want.replace(" x ", " ").replace("x", "").replace("5", "").replace(" ", "").__len__()


def test_placeholders(spark):
    for text, labels, want in [("  ", ["A"], "A"), (" t ", ["A", "B"], "t\nA\nB"), ("t A", ["A", "B"], "t A\nB")]:
        assert one(spark, rg.merged_placeholders(F.col("t"), F.col("l")), t=text, l=labels) == want


def test_crop_rectangle(spark):
    r = F.struct(F.lit(10).alias("x1"), F.lit(90).alias("x2"), F.lit(20).alias("y1"), F.lit(10).alias("y2"))
    got = one(spark, rg.crop_rectangle(r, F.lit(50), F.lit(50)))
    assert (got["w"], got["h"], got["valid"]) == (0, 0, False)
    assert one(spark, rg.crop_rectangle(r, F.lit(50), F.lit(50), wrap=True))["h"] == 30


@pytest.mark.parametrize(("name", "kept"), [("a.png", True), ("a.PNG", True), ("a.pdf-1.png", True), ("a.JPEG", True), ("a.jpg", True), ("a.pdf", False), ("a", False), (".png", False), ("a.png.txt", False)])
def test_extensions(spark, name, kept):
    assert one(spark, tx.is_page_image(F.col("n")), n=name) is kept


def test_trim_takes_all_white_space(spark):
    assert one(spark, tx.unicode_trim(F.col("t")), t=" \n a b \t") == "a b"
    assert one(spark, tx.is_blank(F.col("t")), t=" \n")


def test_argmax_and_probability(spark):
    for v, token, p in [([0.0, 0.0], 0, 0.5), ([1.0, 3.0, 3.0], 1, 1 / (np.exp(-2) + 2)), ([5.0], 0, 1.0)]:
        assert one(spark, vc.argmax(F.col("v")), v=v) == token
        assert one(spark, vc.top_probability(F.col("v")), v=v) == pytest.approx(p)
    nan = float("nan")
    assert one(spark, vc.argmax(F.col("v")), v=[nan, 1.0, nan]) == 1
    assert one(spark, vc.argmax(F.col("v")), v=[nan, nan]) == 0
    assert one(spark, vc.top_probability(F.col("v")), v=[nan, nan]) == 0.0


def test_tokens(spark):
    t = F.transform(F.col("t"), lambda x: x.cast("bigint"))
    assert one(spark, tk.until(t, 9), t=[1, 9, 2]) == [1, 9]
    assert one(spark, tk.until(t, 8), t=[1, 9, 2]) == [1, 9, 2]
    assert one(spark, tk.tail(t, 2), t=[1, 9, 2]) == [9, 2]
    assert one(spark, tk.tail(t, 64), t=[1]) == [1]
    assert one(spark, tk.ends_with(t, [9, 2]), t=[1, 9, 2])
    assert not one(spark, tk.ends_with(t, [1, 9, 2, 3]), t=[9, 2, 3])
    assert one(spark, tk.without(t, [9]), t=[1, 9, 1]) == [1, 1]


def test_repeat_penalty(spark):
    got = one(spark, vc.repeat_penalised(F.col("v"), F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))), v=[1.1, -1.0, 2.0])
    assert got == pytest.approx([1.0, -1.1, 2.0])


@pytest.mark.parametrize(("w", "h", "rw", "rh", "pw", "ph", "tokens"), [(1654, 2339, 1089, 1540, 1092, 1540, 2145), (1700, 2200, 1190, 1540, 1204, 1540, 2365), (1000, 1000, 1540, 1540, 1540, 1540, 3025), (2339, 1654, 1540, 1089, 1540, 1092, 2145)])
def test_sizes(spark, w, h, rw, rh, pw, ph, tokens):
    a, b = sz.resized(F.col("w"), F.col("h"))
    across, down, n = sz.patch_grid(sz.padded(a), sz.padded(b))
    got = spark.createDataFrame([(w, h)], "w int, h int").select(a.alias("a"), b.alias("b"), sz.padded(a).alias("c"), sz.padded(b).alias("d"), n.alias("n")).first()
    assert tuple(got) == (rw, rh, pw, ph, tokens)


def image(spark, gray):
    rows = [(1, y, x, int(v)) for (y, x), v in np.ndenumerate(gray)]
    return spark.createDataFrame(rows, "page_id long, y int, x int, gray int")


def grid(df, column, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def test_boxes_match_brute_force(spark):
    g = np.random.default_rng(3).integers(0, 256, (23, 31))
    p = image(spark, g)
    h, w = g.shape
    near = lambda a, y, x, r: a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
    want = np.array([[255 if g[y, x] < near(g, y, x, 4).sum() // near(g, y, x, 4).size - 5 else 0 for x in range(w)] for y in range(h)])
    t = rs.adaptive_threshold(p, window=9)
    assert (grid(t, "value", g.shape) == want).all()
    fat = np.array([[255 if near(want, y, x, 1).max() > 0 else 0 for x in range(w)] for y in range(h)])
    assert (grid(rs.dilate(t), "value", g.shape) == fat).all()
    thick = np.array([[0 if near(g, y, x, 1).min() < 60 else g[y, x] for x in range(w)] for y in range(h)])
    assert (grid(rs.thicken(p, ink=60), "gray", g.shape) == thick).all()
    counts = {r["y"]: r["n"] for r in rs.row_histogram(rs.dilate(t)).collect()}
    assert counts == {y: int((fat[y] > 0).sum()) for y in range(h)}


@pytest.mark.parametrize("tile", [3, 8, 16, 64])
def test_tiles_do_not_show(spark, tile):
    g = np.random.default_rng(5).integers(0, 256, (37, 45))
    p = image(spark, g)
    for f in (rs.adaptive_threshold, rs.thicken):
        assert f(p, 9, tile=tile).exceptAll(f(p, 9)).isEmpty() and f(p, 9, tile=tile).count() == g.size
    t = rs.adaptive_threshold(p, window=9)
    assert rs.dilate(t, 4, tile=tile).exceptAll(rs.dilate(t, 4)).isEmpty()
    rows = {r["y"]: r["n"] for r in rs.foreground_rows(p, window=9, radius=2, tile=tile).collect()}
    assert rows == {r["y"]: r["n"] for r in rs.row_histogram(rs.dilate(t, 2)).collect()}


def test_boxes_over_gaps_repeats_and_missing_values(spark):
    rng = np.random.default_rng(6)
    rows = [(page, int(y), int(x), None if v < 20 else int(v)) for page in (1, None) for y, x, v in zip(rng.integers(-40, 40, 400), rng.integers(-40, 40, 400), rng.integers(0, 256, 400), strict=True)]
    p = spark.createDataFrame(rows + [(1, None, 3, 7)], "page_id long, y int, x int, gray int").withColumn("ty", F.lit("clashing name"))
    for tile in (7, 512):
        thresholds, thick = Counter(), Counter()
        for page, y, x, v in rows:
            box = [r[3] for r in rows if r[0] == page and abs(r[1] - y) <= 3 and abs(r[2] - x) <= 3]
            mean = sum(b or 0 for b in box) // len(box)
            thresholds[page, y, x, 255 if v is not None and v < mean - 5 else 0] += 1
            thick[page, y, x, 0 if any(b is not None and b < 60 for b in box) else v] += 1
        assert Counter(map(tuple, rs.adaptive_threshold(p, window=7, tile=tile).collect())) == thresholds
        assert Counter(map(tuple, rs.thicken(p, 3, ink=60, tile=tile).collect())) == thick
    none = p.where("page_id = 5")
    assert rs.adaptive_threshold(none).isEmpty() and rs.foreground_rows(none).isEmpty()


def test_a_page_larger_than_a_tile_is_shuffled_once(spark):
    plan = rs.adaptive_threshold(image(spark, np.zeros((4, 4), int)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize(("v", "want"), [([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]), ([7, 0, 0, 0, 0, 0, 0], [7, 0, 0, 1, 0, 0, 0])])
def test_smoothing(spark, v, want):
    df = spark.createDataFrame([(1, y, n) for y, n in enumerate(v)], "page_id long, y int, n long")
    assert [r["n"] for r in rs.smooth_histogram(df).orderBy("y").collect()] == want


@pytest.mark.parametrize(("rows", "want"), [([], []), (range(2, 13), [(2, 13)]), (range(2, 11), []), (range(18, 30), [(18, 30)])])
def test_line_runs(spark, rows, want):
    df = spark.createDataFrame([(1, y, 50 if y in rows else 0) for y in range(30)], "page_id long, y int, n long")
    assert [(r["y1"], r["y2"]) for r in rs.line_runs(df, F.lit(10)).collect()] == want


def test_line_crops(spark):
    cases = [(10, 20, 10, 20), (90, 150, 90, 100), (120, 150, 99, 100), (30, 20, 30, 31)]
    df = spark.createDataFrame([c[:2] for c in cases], "y1 int, y2 int")
    assert [(r["top"], r["bottom"]) for r in rs.line_crops(df, F.lit(100)).collect()] == [c[2:] for c in cases]


def test_patch_merge_order(spark):
    df = spark.createDataFrame([(1, y, x, [10.0 * y + x, 100.0 + 10 * y + x]) for y in range(2) for x in range(2)], "page_id long, py int, px int, v array<double>")
    assert tz.patch_merge(df).first()["merged"] == [0.0, 1.0, 10.0, 11.0, 100.0, 101.0, 110.0, 111.0]


def test_splice_counts_must_agree(spark):
    t = spark.createDataFrame([(1, 0, 9, "a"), (1, 1, 9, "b")], "page_id long, pos int, token int, emb string")
    i = spark.createDataFrame([(1, 0, "x")], "page_id long, k long, image_emb string")
    with pytest.raises(Exception, match="counts differ"):
        tz.splice_positions(t, i, 9).collect()


def test_routing_keeps_single_precision(spark):
    got = spark.createDataFrame([(0.28,), (0.29,)], "c double").select(pg.routed(F.lit("t"), F.lit("o"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == ["t", "o"]


def test_no_page_is_known_in_an_empty_list(spark):
    empty = spark.createDataFrame([], "path string")
    assert pg.any_known(empty, ["a"]).first()["found"] is False
