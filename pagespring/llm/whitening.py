"""Embedding whitening: an exact integer scaling, MLlib's Gramian, a local eigh.

1. Each component c becomes the long x = floor(SCALE * c) + SHIFT.  One pass over the rows
   gives their number n and, exactly, the sums S of every dimension.
2. A RowMatrix of the centred rows (n x - S) / n, whose numerators are exact integers, gives
   the Gramian; divided by n it is the covariance V.  It is dims x dims whatever the rows.
3. ``eigh`` on the driver gives V's eigenvectors; those asked for, dims x components numbers,
   are broadcast, and every row is whitened where it is read (``mapInPandas``).
4. The whitened rows, written once, are centred and multiplied in a second RowMatrix, which
   measures how far their covariance is from the identity.

The sign of a component is fixed: its entry of the largest size is positive.

Defined results: a row whose vector is null, empty, or holds a null or non-finite component
is dropped, and so is one with a component whose x is no long (the fit does not see them);
vectors of different lengths are whitened apart, each length by a fit of its own; a null
vec_id stays null, repeated rows count and stay as rows of their own; a component without
variance (eigenvalue within rounding of zero, as all are for one row or equal rows) has
whitened null and explained 0, and identity_error is over the others (null where there are
none); a deviation above the range of a long is null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LONG_MOST = (1 << 63) - 1
SAFE = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What a fit of vectors of one length gives."""

    n: int
    sums: np.ndarray  # of x, exact: int64, or Python integers where these are too small
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each component
    trace: float

    @property
    def rank(self) -> int:
        """The components whose eigenvalue is more than rounding."""
        return int((self.values > self.trace * len(self.sums) * np.finfo(float).eps).sum()) if self.n else 0


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that remain."""
    c = F.transform(column, lambda v: v.cast("double"))
    r = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))

    def counted(v: Column) -> Column:
        return F.abs(v) < F.lit(float(LONG_MOST // (4 * SCALE)))  # false for null, NaN and infinity

    r = r.where(F.coalesce((F.size("c") > 0) & F.forall("c", lambda v: F.coalesce(counted(v), F.lit(False))), F.lit(False)))
    return r.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length, as they lie."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _wide(a: np.ndarray, factor: int) -> np.ndarray:
    """``a`` as it is where ``factor`` times its largest entry is a safe long, else as Python integers."""
    return a if not a.size or factor * max(int(a.max()), -int(a.min())) < SAFE else a.astype(object)


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """n and the exact sums of the vectors, by their length."""

    def partial(batches):
        import pyarrow as pa

        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                x = _matrix(batch.column(0).filter(pa.array(lengths == dims)))
                n, total = held.get(dims, (0, 0))
                held[dims] = n + len(x), total + _wide(x, len(x)).sum(0).astype(object)
        for dims, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([n]), pa.array([[str(v) for v in total]])], ["dims", "n", "s"])

    parts = rows.select("x").mapInArrow(partial, "dims int, n long, s array<string>")
    parts = parts.select("dims", "n", F.posexplode("s").alias("at", "s"))
    per = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in per.orderBy("dims", "at").toLocalIterator():  # a row for each dimension
        out.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    return {dims: (n, _narrow(np.array(s, object))) for dims, (n, s) in out.items()}


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if len(a) and max(map(abs, a.tolist())) <= LONG_MOST else a


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if sums.dtype != object:
        x = _wide(x, 2 * n)  # |S| is at most n times the largest x of any row
        if x.dtype != object and max(abs(int(sums.max())), abs(int(sums.min()))) < SAFE // 2:
            return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def deviations(d: np.ndarray) -> list[int | None]:
    """The sums of squares of rows of exact integers; None above a long."""
    if d.dtype != object and d.size and d.shape[1] * max(int(d.max()), -int(d.min())) ** 2 <= LONG_MOST:
        return (d * d).sum(1).tolist()
    sums = (d.astype(object) ** 2).sum(1).tolist()
    return [int(s) if s <= LONG_MOST else None for s in sums]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The Gramian of a column of array<double>, by MLlib's RowMatrix."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    vectors = rows.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def fit(rows: DataFrame, n: int, sums: np.ndarray) -> Fit:
    """The fit of n rows (vec_id, x) of one length with these sums."""

    def centre(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                d = centred(_matrix(batch.column(0)), n, sums).astype(float) / n
                yield pa.RecordBatch.from_arrays([_lists(d)], ["d"])

    v = gramian(rows.select("x").mapInArrow(centre, "d array<double>"), "d") / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(sums))])
    return Fit(n, sums, values, vectors * signs, float(np.trace(v)))


def _lists(a: np.ndarray):
    import pyarrow as pa

    ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(a).ravel()))


def whitened_rows(rows: DataFrame, found: Fit, components: int) -> DataFrame:
    """vec_id, deviation, w (array of double, one for each component with variance)."""
    import pandas as pd

    k = min(components, found.rank)
    held = rows.sparkSession.sparkContext.broadcast((found.n, found.sums, found.vectors[:, :k] / np.sqrt(found.values[:k])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, turn = held.value
        for batch in batches:
            if len(batch):
                d = centred(np.stack(batch["x"].to_list()), n, sums)
                w = (d.astype(float) / n) @ turn
                yield pd.DataFrame({"vec_id": batch["vec_id"], "absent": batch["absent"], "deviation": pd.array(deviations(d), "Int64"), "w": list(w)})

    # pandas has no long that may be null
    given = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("absent"), "x")
    out = given.mapInPandas(run, "vec_id long, absent boolean, deviation long, w array<double>")
    return out.select(F.when(~F.col("absent"), F.col("vec_id")).alias("vec_id"), "deviation", "w")


def identity_error(whitened: DataFrame, n: int, k: int) -> float | None:
    """The largest entry by size of the covariance of w, less the identity."""
    if not k:
        return None
    means = whitened.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first()
    d = whitened.select(F.zip_with("w", F.array(*map(F.lit, means)), lambda a, b: a - b).alias("d"))
    return float(np.abs(gramian(d, "d") / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, w, explained (arrays, a value for each component), identity_error.

    The arrays have ``components`` values, or the vector's length if that is less.
    """
    rows = scaled(vectors, column)
    out = []
    for dims, (n, sums) in exact_sums(rows).items():  # one length, as a rule
        own = rows.where(F.size("x") == dims)
        found, k = fit(own, n, sums), min(components, dims)
        w = saved(whitened_rows(own, found, k), spread=True)
        rank = min(k, found.rank)
        error = identity_error(w, found.n, rank)
        explained = [float(e / found.trace) if i < rank else 0.0 for i, e in enumerate(found.values[:k])]
        padded = F.concat("w", F.array_repeat(F.lit(None).cast("double"), k - rank))
        out.append(
            w.select(
                "vec_id",
                F.lit(found.n).cast("long").alias("n"),
                "deviation",
                padded.alias("w"),
                F.array(*map(F.lit, explained)).alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            )
        )
    if not out:
        return vectors.sparkSession.createDataFrame([], "vec_id long, n long, deviation long, w array<double>, explained array<double>, identity_error double")
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole


def op13_whiten(spark, sf_dir: str) -> DataFrame:
    w = whiten(table(spark, sf_dir, "embeddings"))
    each = w.withColumn("each", F.arrays_zip(F.col("w").alias("w"), F.col("explained").alias("explained")))
    each = each.select("vec_id", F.posexplode("each").alias("at", "each"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("each.w").alias("whitened"), F.col("each.explained").alias("explained"), "identity_error")
