"""Files in: documents, page images, configurations; what a run is told of.

Markdown pages are written by ``markdown``, tensors read by ``tensors``, and any folder's files
by ``folders``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension, is_page_image
from .folders import folder as listing
from .markdown import export_markdown as export_markdown
from .tensors import headers

# Fixed value: a glob that takes the image extensions in any case, before files are read.
IMAGE_GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"
DOCUMENT_GLOB = "*.{[pP][dD][fF],[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"
IMAGES = "path string, name string, height int, width int, pixels binary, status string, error string"
PAGES = "doc_name string, page_no int, name string, content binary, status string, error string"


def _listed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """The folder's files that fit, without subfolders; none where the folder is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return reader.load(folder)
    return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of the PDF and image files of a folder, not of its subfolders.

    Names are filtered before contents are read; a missing folder gives no rows.
    """
    named = _listed(spark, folder, DOCUMENT_GLOB).select("path", base_name(F.col("path")).alias("name"), "content")
    return named.where((extension(F.col("name")) == "pdf") | is_page_image(F.col("name")))


def scan_pages(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(path, name[, content]) of page images in path order; a missing folder gives no rows.

    The listing is sorted before contents are read, and files whose names start with ``_`` or
    ``.`` are pages too.  A page that cannot be read is an error here; ``folders.folder`` has
    a row for it.
    """
    found = listing(spark, folder, "*.png,*.jpg,*.jpeg", content=with_content)
    if not with_content:
        return found.select("path", "name")
    unread = F.raise_error(F.concat(F.lit("not read: "), "path", F.lit(": "), "error"))
    return found.select("path", "name", F.when(F.col("status") == "ok", F.col("content")).otherwise(unread.cast("binary")).alias("content"))


def count_files(spark: SparkSession, folder: str) -> int:
    """How many files a folder holds, subfolders not counted; contents are not read."""
    return _listed(spark, folder, "*").select("path").count()


def staging_folder(spark: SparkSession, root: str, run: str) -> str:
    """A new empty folder for one run's intermediate files, under the shared ``root``.

    It belongs to that run alone: a folder left by an earlier run of the same name is
    removed, and nothing else ever is.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/run-{run}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)
    return path.toString()


def rasterise(documents: DataFrame, to_images: Callable[[str, bytes], Iterable[bytes]]) -> DataFrame:
    """One row per page; ``to_images(name, content)`` runs on the executors.

    Images pass through as their own page.  A failing document gives one row with its
    error and no content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                if not name.lower().endswith(".pdf"):
                    rows.append((name, 1, name, content, "ok", None))
                    continue
                try:
                    for n, image in enumerate(to_images(name, content), 1):
                        rows.append((name, n, f"{name}-{n}.png", image, "ok", None))
                except Exception as e:  # kept as a row: one bad file must not end the job
                    rows.append((name, None, None, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["doc_name", "page_no", "name", "content", "status", "error"]).astype({"page_no": "Int32"})

    return documents.select("name", "content").mapInPandas(run, PAGES)


def rasterised(spark: SparkSession, path: str, to_images: Callable[[str, bytes], Iterable[bytes]]) -> DataFrame:
    """``rasterise`` for one document; a path without a file, and a failing document, are errors."""
    document = spark.read.format("binaryFile").load(path).select(base_name(F.col("path")).alias("name"), "content")
    pages = rasterise(document, to_images)
    failed = F.raise_error(F.concat(F.lit("not rasterised: "), "doc_name", F.lit(": "), "error"))
    return pages.withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise(failed))


def decoded_pages(spark: SparkSession, folder: str) -> DataFrame:
    """IMAGES: the folder's page images as RGB rows of bytes, a row each.

    One that cannot be decoded has no pixels and its error; a missing folder gives no rows.
    Transparency is dropped.
    """
    if not count_files(spark, folder):
        return spark.createDataFrame([], IMAGES)
    found = spark.read.format("image").option("pathGlobFilter", IMAGE_GLOB).load(folder)
    found = found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import numpy as np

        for batch in batches:
            rows = []
            for origin, h, w, n, data in batch.itertuples(index=False):
                if h < 0:  # how the reader marks what it cannot decode
                    rows.append((origin, None, None, None, "failed", "the image cannot be decoded"))
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(p, 3, 2) if n == 1 else p[:, :, 2::-1]  # stored as BGR
                rows.append((origin, h, w, rgb.tobytes(), "ok", None))
            frame = pd.DataFrame(rows, columns=["path", "height", "width", "pixels", "status", "error"])
            frame.insert(1, "name", [p.rsplit("/", 1)[-1] for p in frame["path"]])
            yield frame.astype({"height": "Int32", "width": "Int32"})

    return found.mapInPandas(run, IMAGES)


def gray_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, y, x, gray, error) of a folder's images.

    A page image that cannot be decoded gives one row with its error and no pixel; other
    files that are no images are left out.
    Gray is (2126 r + 7152 g + 722 b) / 10000 in whole numbers; data is stored as BGR.
    """
    images = spark.read.format("image").load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    images = images.where((F.col("height") >= 0) | is_page_image(base_name(F.col("origin"))))

    def run(batches):
        import numpy as np

        for batch in batches:
            for origin, h, w, n, data in batch.itertuples(index=False):
                if h < 0:  # how the reader marks what it cannot decode
                    failed = pd.DataFrame({"path": [origin], "y": [None], "x": [None], "gray": [None], "error": ["the image cannot be decoded"]})
                    yield failed.astype({"y": "Int32", "x": "Int32", "gray": "Int32"})
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                gray = p[:, :, 0] if n == 1 else (722 * p[:, :, 0] + 7152 * p[:, :, 1] + 2126 * p[:, :, 2]) // 10000
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"path": origin, "y": y.astype("int32"), "x": x.astype("int32"), "gray": gray.ravel().astype("int32"), "error": None})

    return images.mapInPandas(run, "path string, y int, x int, gray int, error string")


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, tensor, shape, dtype) from the headers of safetensors files; no data are read."""
    return headers(spark, path).select("file", "tensor", F.array_join("shape", "x").alias("shape"), "dtype")


def write_tensor_table(headers: DataFrame, folder: str) -> None:
    """The tensor table as tab-separated text."""
    headers.select("tensor", "shape", "dtype").write.mode("overwrite").csv(folder, sep="\t")


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, by an explicit schema; a file that does not fit is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def observed(rows: DataFrame, name: str):
    """rows and the metrics that their run will have: (frame, observation).

    ``observation.get`` holds rows, failed and chars once an action has run; nothing is
    read twice for them.
    """
    from pyspark.sql import Observation

    seen = Observation(name)
    failed = F.count_if(F.col("status") == "failed") if "status" in rows.columns else F.lit(0).cast("bigint")
    text = next((c for c in ("processed_output", "text") if c in rows.columns), None)
    chars = F.sum(F.length(text)) if text else F.lit(0).cast("bigint")
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed"), F.coalesce(chars, F.lit(0)).alias("chars")), seen
