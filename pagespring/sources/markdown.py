"""Markdown pages as files of their own, by a Python data source with a commit protocol.

1. A task writes its pages into a folder of its attempt, with a manifest of what it wrote:
   ``<folder>/_staging/<job>/<partition>-<attempt>``.  A task that fails removes that folder.
2. The job's commit names the attempts that count in one file, ``_committed.json``: a task that ran
   twice counts once.  A job that fails removes all it staged.
3. Publishing is a job over the manifests alone: names are counted, each page whose name stands
   once is moved to ``<folder>/<name>.md``, and what became of every page is written to the
   session's shared folder.  It can be run again from the commit file; texts are never
   shuffled, the pages are computed once, and at the end the folder holds Markdown alone.

Defined results: a null text gives an empty file; a null name, a name with a separator in it, and
every row of a name that stands more than once give a row with an error and no file; an older
file of a name is replaced; no pages give no files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store import new_folder, store_of

FORMAT = "pagespring_markdown"
MANIFEST = "name string, file string, error string"
EXPORTED = "path string, status string, error string"


@dataclass
class Attempt(WriterCommitMessage):
    """A task's folder below the job's."""

    folder: str
    pages: int


class MarkdownWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str) -> None:
        self.staging = f"{folder.rstrip('/')}/_staging/{job}"

    def write(self, iterator: Iterator) -> Attempt:
        from pyspark import TaskContext

        context = TaskContext.get()
        own = f"{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        fs, folder = store_of(f"{self.staging}/{own}")
        fs.create_dir(folder, recursive=True)
        try:
            n = 0
            with fs.open_output_stream(f"{folder}/manifest.json") as manifest:
                for row in iterator:
                    name, text, error = row["name"], row["processed_output"], None
                    if not name:
                        error = "a page without a name"
                    elif "/" in name:
                        error = "a name with a separator"
                    else:
                        with fs.open_output_stream(f"{folder}/{n}.md") as f:
                            f.write((text or "").encode())
                    manifest.write((json.dumps({"name": name, "file": None if error else f"{self.staging}/{own}/{n}.md", "error": error}) + "\n").encode())
                    n += 1
        except BaseException:
            fs.delete_dir(folder)
            raise
        return Attempt(own, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, staging = store_of(self.staging)
        fs.create_dir(staging, recursive=True)
        with fs.open_output_stream(f"{staging}/_committed.json") as f:
            f.write(json.dumps([m.folder for m in messages if m and m.pages]).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        _removed(self.staging)


class MarkdownSink(DataSource):
    """Rows (name, processed_output); options path (the folder) and job."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options["path"], self.options["job"])


def _removed(path: str) -> None:
    """Deletes a folder, and the staging folder above it once that is empty."""
    from pyarrow import fs as pafs

    fs, inner = store_of(path)
    if fs.get_file_info(inner).type == pafs.FileType.Directory:
        fs.delete_dir(inner)
    above = inner.rsplit("/", 1)[0]
    if above.endswith("/_staging") and fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
        fs.delete_dir(above)


def stage(pages: DataFrame, folder: str) -> str:
    """Writes and commits the pages' files under a new job, and returns the job."""
    job = uuid.uuid4().hex
    pages.sparkSession.dataSource.register(MarkdownSink)
    rows = pages.select(F.col("name").cast("string"), F.col("processed_output").cast("string"))
    rows.write.format(FORMAT).mode("append").option("path", folder).option("job", job).save()
    return job


def publish(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """Moves the committed files of a job to their names: (path, status, error) of its pages.

    Run again after a crash it goes on where it stopped.
    """
    top = folder.rstrip("/")
    staging = f"{top}/_staging/{job}"
    fs, inner = store_of(f"{staging}/_committed.json")
    with fs.open_input_stream(inner) as f:
        tasks = json.loads(f.read())
    result = new_folder(spark)
    if tasks:
        pages = spark.read.schema(MANIFEST).json([f"{staging}/{t}/manifest.json" for t in tasks])
        counts = pages.where("error is null").groupBy("name").agg(F.count("*").alias("same"))
        pages = pages.join(counts, "name", "left")

        def run(batches):
            for batch in batches:
                rows = []
                for name, file, error, same in zip(batch["name"], batch["file"], batch["error"], batch["same"], strict=True):
                    if error is not None:
                        rows.append((None, "failed", error))
                    elif same > 1:
                        rows.append((f"{top}/{name}.md", "failed", "several pages of one name"))
                    else:
                        rows.append((f"{top}/{name}.md", *_moved(file, f"{top}/{name}.md")))
                yield pd.DataFrame(rows, columns=["path", "status", "error"])

        pages.select("name", "file", "error", "same").mapInPandas(run, EXPORTED).write.parquet(result)
    else:
        spark.createDataFrame([], EXPORTED).write.parquet(result)
    _removed(staging)
    return spark.read.schema(EXPORTED).parquet(result)


def _moved(file: str, path: str) -> tuple[str, str | None]:
    """Status and error of a move, which an earlier attempt may have made."""
    from pyarrow import fs as pafs

    fs, source = store_of(file)
    _, target = store_of(path)
    try:
        if fs.get_file_info(source).type == pafs.FileType.File:
            fs.move(source, target)
        elif fs.get_file_info(target).type != pafs.FileType.File:
            return "failed", "the staged file is gone"
    except OSError as e:
        return "failed", str(e)
    return "ok", None


def export_markdown(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``folder/name.md`` for rows (name, processed_output): (path, status, error).

    The folder must be one that all executors share; it may be a URI.
    """
    return publish(pages.sparkSession, folder, stage(pages, folder))
