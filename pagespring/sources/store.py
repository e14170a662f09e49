"""Where files are: paths and URIs that executors and the driver open alike."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def store_of(path: str):
    """(file system, path in it) of a local path, or of a URI that pyarrow knows (file, hdfs,
    viewfs, s3, gs, abfs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:  # paths are plain text, as Spark shows them
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")
    return fs.LocalFileSystem(), os.path.abspath(path)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which every executor sees.

    Only a session on one machine may leave that setting out; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagespring-"))
        found = spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/pagespring/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, its lineage cut."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
