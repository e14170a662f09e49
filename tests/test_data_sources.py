"""The folder source, the tensor source and the Markdown sink."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespring.sources import files as fl
from pagespring.sources import folders as fo
from pagespring.sources import markdown as md
from pagespring.sources import tensors as tn

# folders


def test_folder_rows(spark, tmp_path):
    for name, content in (("b.PNG", b"bb"), ("a.png", b"a"), ("_hidden.png", b"h"), (".dot.jpg", b"d"), ("note.txt", b"n"), ("empty.png", b"")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.png").write_bytes(b"c")
    os.mkfifo(tmp_path / "broken.png")
    rows = fo.folder(spark, str(tmp_path)).collect()
    assert [r["name"] for r in rows] == sorted(["b.PNG", "a.png", "_hidden.png", ".dot.jpg", "note.txt", "empty.png", "broken.png"])
    by = {r["name"]: r for r in rows}
    assert by["b.PNG"]["content"] == b"bb" and by["empty.png"]["content"] == b"" and by["_hidden.png"]["status"] == "ok"
    assert by["broken.png"]["status"] == "failed" and by["broken.png"]["content"] is None and by["broken.png"]["error"]
    assert all(r["length"] == len(r["content"]) for r in rows if r["status"] == "ok")
    # a file that is gone by the time it is read
    (gone,) = fo.FolderReader({"path": str(tmp_path)}).read(fo.Files([(str(tmp_path / "gone.png"), "gone.png", 3, 1)]))
    assert gone[4:6] == (None, "failed") and gone[6]
    some = fo.folder(spark, f"file://{tmp_path}", "*.png,*.jpg", content=False)
    assert [r["name"] for r in some.collect()] == sorted(["b.PNG", "a.png", "_hidden.png", ".dot.jpg", "empty.png", "broken.png"]) and some.where("content is not null").count() == 0
    assert fo.folder(spark, str(tmp_path / "missing")).count() == 0 and fo.folder(spark, str(tmp_path / "sub"), "*.jpg").count() == 0


def test_parts_follow_the_order_of_paths(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"p{k:02d}.png").write_bytes(bytes(100))
    df = fo.folder(spark, str(tmp_path), part=1000)
    assert df.rdd.getNumPartitions() == 4
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    assert [r["name"] for r in rows] == [f"p{k:02d}.png" for k in range(40)]
    assert [sum(r["part"] == p for r in rows) for p in range(4)] == [10] * 4
    pages = fl.scan_pages(spark, str(tmp_path), with_content=True)
    assert "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()
    assert [r["name"] for r in pages.collect()] == [f"p{k:02d}.png" for k in range(40)]


def test_stream_of_files(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()

    def put(name, t):
        (inbox / name).write_text(name)
        os.utime(inbox / name, ns=(t, t))

    def run():
        q = fo.arriving(spark, str(inbox), "*.txt").select("name", "content").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return sorted(r["name"] for r in spark.read.parquet(out).collect())

    put("b.txt", 1000)
    put("a.txt", 2000)
    put("x.png", 2500)
    assert run() == ["a.txt", "b.txt"]
    put("c.txt", 3000)
    put("_d.txt", 3000)
    assert run() == ["_d.txt", "a.txt", "b.txt", "c.txt"]
    assert run() == ["_d.txt", "a.txt", "b.txt", "c.txt"]


# tensors


def safetensors(path, tensors):
    about, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (dtype, shape, raw) in tensors.items():
        about[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(about).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)


@pytest.fixture
def model(tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6)).astype(np.float32)
    half = x.astype(np.float16)
    brain = (x.view(np.uint32) >> 16).astype(np.uint16)
    safetensors(
        tmp_path / "m.safetensors",
        {
            "x": ("F32", [50, 6], x.tobytes()),
            "half": ("F16", [50, 6], half.tobytes()),
            "brain": ("BF16", [50, 6], brain.tobytes()),
            "ids": ("I64", [3], np.array([1, -2, 2**40], np.int64).tobytes()),
            "scalar": ("F64", [], np.array(2.5).tobytes()),
            "none": ("F32", [0, 4], b""),
            "cube": ("U8", [2, 3, 4], bytes(range(24))),
        },
    )
    (tmp_path / "note.txt").write_text("x")
    want = {"x": x, "half": half, "brain": (brain.astype(np.uint32) << 16).view(np.float32), "ids": [1, -2, 2**40], "scalar": [2.5], "none": [], "cube": list(range(24))}
    return str(tmp_path), {k: np.asarray(v, np.float64).ravel() for k, v in want.items()}


@pytest.mark.parametrize("size", [tn.RANGE, 100])
def test_tensors_come_back(spark, model, size):
    folder, want = model
    rows = tn.tensors(spark, folder, size).collect()
    for name, values in want.items():
        own = sorted((r for r in rows if r["tensor"] == name), key=lambda r: r["first"])
        assert np.array_equal(np.concatenate([r["values"] for r in own]), values)
        assert sum(r["rows"] for r in own) == (own[0]["shape"][0] if own[0]["shape"] else 1)
    if size == 100:
        assert sum(r["tensor"] == "x" for r in rows) == 13  # four rows of 24 bytes each
    got = tn.vectors(spark, folder, "x").orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(50)) and np.array_equal(np.array([r["v"] for r in got]).ravel(), want["x"])
    assert tn.vectors(spark, folder, "none").count() == 0


def test_filters_reach_the_reader(spark, model):
    folder, _ = model
    df = tn.tensors(spark, folder, 100).where("tensor = 'half' and dtype in ('F16', 'F32')")
    assert df.rdd.getNumPartitions() == 7  # eight rows of 12 bytes each: the others are not planned
    assert {r["tensor"] for r in df.collect()} == {"half"}
    assert tn.tensors(spark, folder).where("tensor = 'no such'").count() == 0
    assert {r["tensor"] for r in tn.headers(spark, folder).where("dtype = 'BF16'").collect()} == {"brain"}


def test_bytes_read(model, monkeypatch):
    folder, want = model
    reader = tn.TensorReader({"path": folder, "range": "100"})
    assert list(reader.pushFilters([tn.EqualTo(("tensor",), "x"), tn.EqualTo(("first",), 0)])) == [tn.EqualTo(("first",), 0)]
    parts = reader.partitions()
    assert sum(p.size for p in parts) == 50 * 6 * 4 and max(p.size for p in parts) <= 100
    seen = []
    store = tn.store_of

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            seen.append(n)
            return self.f.read_at(n, at)

    class Store:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, p):
            return Counting(self.fs.open_input_file(p))

    monkeypatch.setattr(tn, "store_of", lambda p: (Store(store(p)[0]), store(p)[1]))
    values = np.concatenate([b.column(6).flatten().to_numpy() for p in parts for b in reader.read(p)])
    assert sum(seen) == 50 * 6 * 4 and np.array_equal(values, want["x"])


def test_files_that_do_not_fit(spark, tmp_path):
    (tmp_path / "short.safetensors").write_bytes(struct.pack("<Q", 10_000) + b"{}")
    with pytest.raises(Exception, match="not a safetensors file"):
        tn.tensors(spark, str(tmp_path)).collect()
    (tmp_path / "short.safetensors").unlink()
    safetensors(tmp_path / "odd.safetensors", {"x": ("F32", [3], b"12345678")})
    with pytest.raises(Exception, match="does not fit its bytes"):
        tn.headers(spark, str(tmp_path)).collect()


def test_vectors_round_trip(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id AS id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS v").repartition(3)
    folder = str(tmp_path / "out")
    assert tn.write_vectors(e, folder).agg(F.sum("rows")).first()[0] == e.count()
    assert sorted(os.listdir(folder)) == [f"part-{k:05d}.safetensors" for k in range(3)]
    ids = tn.vectors(spark, folder, "ids").select("file", "row", F.col("v")[0].cast("bigint").alias("id"))
    back = {r["id"]: r["v"] for r in tn.vectors(spark, folder, "v").join(ids, ["file", "row"]).collect()}
    assert back == {r["id"]: r["v"] for r in e.collect()}


# Markdown


def pages(spark, rows):
    return spark.createDataFrame(rows, "name string, processed_output string").repartition(3)


def visible(folder):
    return sorted(p for p in os.listdir(folder) if not p.startswith(("_", "."))) if os.path.isdir(folder) else []


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_export(spark, tmp_path, prefix):
    folder = str(tmp_path / "out")
    rows = [("a", "x"), ("a", "y"), ("b", None), (None, "z"), ("", "e"), ("c/d", "s"), ("é", "ü\n")]
    got = md.export_markdown(pages(spark, rows), prefix + folder).collect()
    assert visible(folder) == ["b.md", "é.md"] and open(f"{folder}/é.md", encoding="utf-8").read() == "ü\n" and open(f"{folder}/b.md").read() == ""
    assert sorted((r["status"], r["error"] or "") for r in got) == sorted([("ok", "")] * 2 + [("failed", "several pages of one name")] * 2 + [("failed", "a page without a name")] * 2 + [("failed", "a name with a separator")])
    assert not os.path.exists(f"{folder}/_staging")
    md.export_markdown(pages(spark, [("b", "new")]), prefix + folder)
    assert open(f"{folder}/b.md").read() == "new" and visible(folder) == ["b.md", "é.md"]
    assert md.export_markdown(pages(spark, rows).limit(0), prefix + folder).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = pages(spark, [(f"p{k}", "x") for k in range(20)])
    broken = rows.withColumn("processed_output", F.when(F.col("name") == "p13", F.raise_error(F.lit("no text"))).otherwise(F.col("processed_output")))
    with pytest.raises(Exception, match="no text"):
        md.export_markdown(broken, folder)
    assert visible(folder) == [] and not any(files for _, _, files in os.walk(folder))


def test_a_repeated_task_counts_once(spark, tmp_path):
    folder, job = str(tmp_path / "out"), "job"
    writer = md.MarkdownWriter(folder, job)
    first = [{"name": "a", "processed_output": "one"}, {"name": "b", "processed_output": "two"}]
    lost, again = writer.write(iter(first)), writer.write(iter(first))
    other = writer.write(iter([{"name": "c", "processed_output": "three"}]))
    assert lost.folder != again.folder and visible(folder) == []
    writer.commit([again, other, None])
    got = md.publish(spark, folder, job).collect()
    assert visible(folder) == ["a.md", "b.md", "c.md"] and {r["status"] for r in got} == {"ok"} and len(got) == 3

    def failing():
        yield {"name": "x", "processed_output": "x"}
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        md.MarkdownWriter(folder, "other").write(failing())
    assert not any(files for _, _, files in os.walk(f"{folder}/_staging"))


def test_publishing_goes_on_after_a_crash(spark, tmp_path):
    folder, job = str(tmp_path / "out"), "job"
    writer = md.MarkdownWriter(folder, job)
    done = writer.write(iter([{"name": f"p{k}", "processed_output": str(k)} for k in range(5)]))
    writer.commit([done])
    os.rename(f"{folder}/_staging/{job}/{done.folder}/2.md", f"{folder}/p2.md")  # one was moved before
    assert {r["status"] for r in md.publish(spark, folder, job).collect()} == {"ok"}
    assert [open(f"{folder}/p{k}.md").read() for k in range(5)] == list("01234")
    writer = md.MarkdownWriter(folder, "gone")
    writer.commit([writer.write(iter([{"name": "q", "processed_output": "q"}]))])
    (staged,) = (p for p, _, files in os.walk(f"{folder}/_staging") if "0.md" in files)
    os.unlink(f"{staged}/0.md")
    assert [r["error"] for r in md.publish(spark, folder, "gone").collect()] == ["the staged file is gone"]
