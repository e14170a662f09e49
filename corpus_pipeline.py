"""The corpus pipeline: toxicity, near-duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again before the next stage is called; all but the last return the columns of
``documents``.  A stage may therefore remove the working files of the stage before it in
the same run: that of the application, the thread and the tables' folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespring.llm import common, mixing, neardup, packing, repeats, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS = 5
#: The working files of each run's last stage.
_runs: dict[tuple, list[str]] = {}


def _stage(f: Callable) -> Callable:
    """Removes the working files of the run's stage before and notes this one's."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, threading.get_ident(), sf_dir)
        common.clear(spark, _runs.pop(key, []))
        with common.noting() as paths:
            try:
                return f(spark, docs, sf_dir)
            finally:
                _runs[key] = paths

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose score reaches toxicity.REJECT."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.REJECT).select(*COLUMNS)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the smallest doc_id (null last).

    Rows are told apart by doc_id and text, so different texts may share a doc_id; rows
    equal in both are one where the doc_id is not null.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = docs.withColumn("row", F.col("doc_id").cast("long"))
    else:
        one = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        rows = one.union(docs.where("doc_id is null")).orderBy(F.asc_nulls_last("doc_id"), *COLUMNS[1:])
        # numbers in the rows' order, fixed by being written
        rows = common.saved(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = neardup.linked(rows.select(F.col("row").alias("doc_id"), "text"), width=WORDS)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte covered by a string of repeats.LEAST bytes that starts elsewhere too."""
    cut = repeats.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to the sources' target weights, in one random order."""
    return mixing.mix(docs).select(*COLUMNS)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; ``ids`` has each piece's tokens."""
    return packing.pack(docs, packing.default_tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), spread=True)
        if before:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The model, the hashes' components and the packer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
