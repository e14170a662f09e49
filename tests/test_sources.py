import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagespring.sources import backends as bk
from pagespring.sources import files as fl
from pagespring.streaming import recognise_arriving


def png(gray: np.ndarray) -> bytes:
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = gray.shape
    raw = b"".join(b"\0" + row.tobytes() for row in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_and_pixels(spark, tmp_path):
    g = np.arange(12).reshape(3, 4) * 20
    (tmp_path / "b.PNG").write_bytes(png(g))
    (tmp_path / "a.png").write_bytes(png(255 - g))
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(png(g))
    assert [r["name"] for r in fl.scan_pages(spark, str(tmp_path)).collect()] == ["a.png", "b.PNG"]
    p = fl.gray_pixels(spark, str(tmp_path)).where(F.col("path").endswith("b.PNG"))
    assert {(r["y"], r["x"]): r["gray"] for r in p.collect()} == {k: int(v) for k, v in np.ndenumerate(g)}


def test_undecodable_images_give_a_row(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.full((2, 3), 9)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    rows = fl.gray_pixels(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["y"], r["x"], r["gray"]) for r in rows if r["error"]] == [("bad.png", None, None, None)]
    assert sorted((r["y"], r["x"], r["gray"]) for r in rows if not r["error"]) == [(y, x, 9) for y in range(2) for x in range(3)]


def test_rasterise_keeps_failures_apart(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"two")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.png").write_bytes(b"img")

    def to_images(name, content):
        if content == b"bad":
            raise ValueError("no pages")
        return [content + b"1", content + b"2"]

    rows = fl.rasterise(fl.scan_documents(spark, str(tmp_path)), to_images).collect()
    assert sorted((r["doc_name"], r["name"], r["status"]) for r in rows if r["name"]) == [("a.pdf", "a.pdf-1.png", "ok"), ("a.pdf", "a.pdf-2.png", "ok"), ("c.png", "c.png", "ok")]
    assert [(r["doc_name"], r["error"]) for r in rows if r["status"] == "failed"] == [("b.pdf", "no pages")]


def test_pages_to_markdown(spark, tmp_path):
    class Fixed:
        def recognise(self, contents):
            if contents[0] == b"bad":
                raise ValueError("unreadable")
            return [("see ![image](image_1.png) 0,0,500,500 end", 0.9, 1654, 2339)]

    pages = spark.createDataFrame([("p.png", bytearray(b"x")), ("q.png", bytearray(b"bad"))], "name string, content binary")
    seen = bk.recognise(pages, Fixed)
    assert {r["name"]: r["status"] for r in seen.collect()} == {"p.png": "ok", "q.png": "failed"}
    done = bk.caption(seen.where("status = 'ok'"), bk.StubCaptioner)
    out = fl.export_markdown(done, str(tmp_path / "out")).collect()
    assert [r["status"] for r in out] == ["ok"]
    text = (tmp_path / "out" / "p.png.md").read_text()
    assert text.startswith("see [figure ") and text.endswith("] end")


def test_lines_are_joined_in_order(spark):
    crops = spark.createDataFrame([("p", 1, bytearray(b"22")), ("p", 0, bytearray(b"1"))], "name string, line_idx int, crop binary")
    assert bk.read_lines(crops, bk.StubLineReader).first()["text"] == "line 1\nline 2"
    lines = spark.createDataFrame([("p", 1, " b "), ("p", 0, " "), ("p", 2, "c")], "name string, line_idx int, line string")
    assert bk.joined_lines(lines).first()["text"] == "b\nc"


def test_tensor_headers_and_config(spark, tmp_path):
    head = json.dumps({"w": {"dtype": "BF16", "shape": [2, 3], "data_offsets": [0, 12]}, "__metadata__": {}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 12)
    r = fl.tensor_headers(spark, str(tmp_path / "m.safetensors")).first()
    assert (r["tensor"], r["shape"], r["dtype"]) == ("w", "2x3", "BF16")
    (tmp_path / "c.json").write_text('{"a": 1,\n "b": {"c": [1, 2]}}')
    assert fl.read_config(spark, str(tmp_path / "c.json"), "a int, b struct<c: array<int>>").first()["b"]["c"] == [1, 2]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.png").write_bytes(b"1")
    for name in ("b.png", "b.txt"):
        q = recognise_arriving(spark, str(source), str(out), str(tmp_path / "cp"), bk.StubRecogniser)
        q.processAllAvailable()
        q.stop()
        (source / name).write_bytes(b"2")
    q = recognise_arriving(spark, str(source), str(out), str(tmp_path / "cp"), bk.StubRecogniser)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["name"] for r in spark.read.parquet(str(out)).collect()) == ["a.png", "b.png"]
