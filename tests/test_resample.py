import numpy as np
import pytest

from pagespring.functions import resample as rs
from pagespring.functions.prompts import AFTER, BARE, BEFORE, prompt


@pytest.mark.parametrize("kernel", ["lanczos3", "triangle"])
@pytest.mark.parametrize(("old", "new"), [(10, 10), (10, 3), (3, 10)])
def test_weights(kernel, old, new):
    w = rs.weights(old, new, kernel)
    assert w.shape == (new, old)
    assert np.allclose(w.sum(1), 1)
    if old == new:
        assert np.allclose(w, np.eye(old), atol=1e-12)


def test_flat_images_stay_flat():
    flat = np.full((7, 5, 3), 99, np.uint8)
    assert (rs.resize(flat, 13, 4) == 99).all()
    assert (rs.resize_to_fill(flat, 6) == 99).all()


def test_recogniser_input():
    x, down, across = rs.recogniser_input(np.full((220, 170, 3), 255, np.uint8))
    assert (down, across) == (110, 86)
    assert x.shape == (3, 1540, 1204)
    assert x[0, 0, 0] == pytest.approx((1 - rs.MEAN[0]) / rs.STD[0], rel=1e-6)
    assert x[2, 0, -1] == pytest.approx(-rs.MEAN[2] / rs.STD[2], rel=1e-6)  # padding is black


def test_square_inputs():
    image = np.random.default_rng(0).integers(0, 256, (40, 90, 3)).astype(np.uint8)
    assert rs.captioner_input(image).shape == (3, 378, 378)
    x = rs.line_input(image, thick=True)
    assert x.shape == (3, 384, 384) and x.min() == -1


def test_thickening():
    image = np.full((5, 5, 3), 255, np.uint8)
    image[2, 2] = 0
    assert (rs.thickened(image)[1:4, 1:4] == 0).all() and rs.thickened(image)[0].min() == 255


def test_prompts():
    assert prompt(" \n") == BARE
    assert prompt("x" * 400) == BEFORE + "x" * 300 + AFTER
    assert BARE.startswith("\n\nQuestion:") and AFTER.endswith("\n\nAnswer:")


def test_relations_are_the_images(spark):
    rng = np.random.default_rng(12)
    from pagespring.operators import resampling as rz

    for h, w, nh, nw, kernel in ((13, 20, 7, 9, "lanczos3"), (13, 20, 26, 41, "lanczos3"), (16, 12, 8, 6, "triangle"), (5, 9, 11, 3, "triangle"), (1, 1, 3, 2, "lanczos3")):
        image = rng.integers(0, 256, (h, w, 1)).astype(np.uint8)
        rows = [(7, y, x, int(v), h, w, nh, nw) for (y, x, _), v in np.ndenumerate(image)]
        df = spark.createDataFrame(rows, "page_id long, y int, x int, gray int, h int, w int, nh int, nw int")
        got = np.zeros((nh, nw, 1), np.uint8)
        found = rz.resampled(df, kernel).collect()
        for r in found:
            got[r["y"], r["x"], 0] = r["gray"]
        assert len(found) == nh * nw and np.array_equal(got, rs.resize(image, nw, nh, kernel))
    image = rng.integers(0, 256, (21, 34, 1)).astype(np.uint8)
    df = spark.createDataFrame([(y % 1, y, x, int(v), 21, 34) for (y, x, _), v in np.ndenumerate(image)], "page_id int, y int, x int, gray int, h int, w int")
    got = {(r["y"], r["x"]): r["gray"] for r in rz.filled(df, 12).collect()}
    want = rs.resize_to_fill(image, 12)
    assert got == {(y, x): int(v) for (y, x, _), v in np.ndenumerate(want)}
    assert rz.resampled(df.selectExpr("*", "0 AS nh", "3 AS nw")).count() == 0 and rz.filled(df.limit(0), 12).count() == 0
