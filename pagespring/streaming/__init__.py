"""Incremental ingestion: page images that arrive in a folder become recognised pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..sources.backends import Recogniser, recognise
from ..sources.files import IMAGE_GLOB

# Fixed value: the columns of Spark's file source.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (path, name, content)."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", IMAGE_GLOB).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select("path", base_name(F.col("path")).alias("name"), "content")


def recognise_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, factory: Callable[[], Recogniser]):
    """Starts a query that appends recognised pages to Parquet, each file once."""
    return recognise(arriving_pages(spark, folder), factory).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
