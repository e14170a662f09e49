"""What several operators share: table reads, written intermediates, text helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of the batches that go to Python: ten thousand long texts are too much to hold twice.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send at most BATCH_ROWS rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def one_thread() -> None:
    """Has tokenizers encode in the calling thread: a task has one core, and each further
    thread keeps memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_kept: list[dict] = []


def keeping() -> dict:
    """A dict of what a worker keeps from task to task, which ``leave`` empties."""
    _kept.append({})
    return _kept[-1]


def leave() -> None:
    """Frees what this process keeps for another stage's tasks.

    Spark gives a stage the workers of the stage before, and their memory with them; so what is
    freed also goes back to the system, where the C library can do that.
    """
    for held in _kept:
        held.clear()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The list of the folders that ``saved`` writes inside the block, in this thread."""
    paths: list[str] = []
    before = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``).

    Only a session on one machine may leave it out, as tests do; it gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagespring-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediates go; ``clear(spark, [scratch_dir(spark)])`` removes all."""
    return f"{shared_dir(spark)}/pagespring/{spark.sparkContext.applicationId}"


#: Shuffle partitions that one task of ``saved`` takes in turn, where the cores allow it.
IN_TURN = 8
#: Rows that a file holds where their number is known.
ROWS_A_FILE = 200_000


def scratch(spark: SparkSession) -> str:
    """A folder of its own for intermediates, noted as those of ``saved`` are."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


def saved(df: DataFrame, spread: bool = False, rows: int | None = None, at: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder (``at``: this place in it) and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    later plans see the true size.  The schema is kept as given.  What comes out of a
    shuffle goes to fewer files than it has partitions: a task takes some in turn, each in
    memory on its own, and at least four tasks a core are left; with ``rows``, the most that there can
    be, no more files than these fill.  ``spread``: a file for each task, for rows that come
    straight from a table.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    if not spread:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files = max(4 * spark.sparkContext.defaultParallelism, -(-partitions // IN_TURN))
        df = df.coalesce(files if rows is None else max(1, min(files, -(-rows // ROWS_A_FILE))))
    path = at or scratch(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``saved`` returned."""
    top = scratch_dir(df.sparkSession)
    clear(df.sparkSession, sorted({f"{top}/{name.rsplit('/', 2)[-2]}" for name in df.inputFiles()}))


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of ``saved``, once nothing reads them any more."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def unit_hash(*parts: Column | str) -> Column:
    """A uniform double in (0, 1) from the md5 of the parts' text.

    52 bits, so the double is exact; SQL engines with md5 give the same value.
    """
    digest = F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


#: Bits of the largest filter that ``likely`` broadcasts: 32 MB.
FILTER_BITS_MOST = 1 << 28


def likely(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be among ``ids`` (one column); none that is gets lost.

    A bitmap of hashed ids, at most FILTER_BITS_MOST bits whatever the number of ids, is
    broadcast; so a join on the exact ids that follows shuffles little else.
    """
    n = ids.count()
    bits = min(FILTER_BITS_MOST, max(1 << 18, 1 << (16 * n).bit_length()))
    name = ids.columns[0]

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("filter"), F.col(c)), F.lit(bits)) + 1

    marks = ids.groupBy(F.bitmap_bucket_number(place(name)).alias("filter bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(name))).alias("filter bits"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col("filter bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    joined = rows.withColumn("filter at", F.bitmap_bucket_number(place(key))).join(F.broadcast(marks), F.expr("`filter at` = `filter bucket`"))
    return joined.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)
