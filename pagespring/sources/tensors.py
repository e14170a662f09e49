"""Tensors in safetensors files as rows: a Python data source that reads byte ranges.

A row is a run of a tensor's leading entries (its rows, for a matrix): ``first`` is the number
of the first of them.  Headers are read when a scan is planned; a partition is a run of RANGE
bytes of one tensor at most, and reads those bytes alone.  Filters on ``tensor``, ``dtype`` and ``file``
(equality, IN) are pushed down, so other tensors' bytes are never read; ``headers`` reads none.

Defined results: a tensor without entries gives one row without values; a scalar is a run of
one; numbers come as doubles (F64, F32, F16, BF16, the integers and BOOL; 64-bit integers
above 2**53 lose their last bits); another dtype, and a header that does not fit its
file, are errors; a missing folder is one too; files of a folder that are no ``.safetensors`` are
left out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .store import store_of

FORMAT = "pagespring_tensors"
RANGE = 8 << 20
SCHEMA = "file string, tensor string, dtype string, shape array<bigint>, first bigint, rows bigint, values array<double>"
#: Bytes that a header may have: the format's own limit.
HEADER_MOST = 100_000_000

# The format's names of number types.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1", "U8": "|u1", "U16": "<u2", "U32": "<u4", "BOOL": "|u1"}


def decoded(data: bytes, dtype: str) -> np.ndarray:
    """The numbers of little-endian bytes."""
    x = np.frombuffer(data, KINDS[dtype])
    if dtype == "BF16":  # the upper half of a single-precision number
        x = (x.astype(np.uint32) << 16).view(np.float32)
    return x.astype(np.float64)


def header(path: str) -> tuple[int, dict]:
    """Where the data begin, and the tensors' entries of a file."""
    fs, inner = store_of(path)
    with fs.open_input_file(inner) as f:
        size = struct.unpack("<Q", f.read(8))[0]
        if size > min(HEADER_MOST, f.size() - 8):
            raise ValueError(f"not a safetensors file: {path}")
        about = json.loads(f.read(size))
        about.pop("__metadata__", None)
        for name, entry in about.items():
            lo, hi = entry["data_offsets"]
            n = int(np.prod(entry["shape"], dtype=object))
            if entry["dtype"] not in KINDS:
                raise ValueError(f"dtype {entry['dtype']} of {name} in {path}")
            if hi - lo != n * np.dtype(KINDS[entry["dtype"]]).itemsize or 8 + size + hi > f.size():
                raise ValueError(f"{name} does not fit its bytes in {path}")
    return 8 + size, about


class Run(InputPartition):
    """A run of a tensor's leading entries."""

    def __init__(self, file: str, tensor: str, dtype: str, shape: list[int], first: int, rows: int, start: int, size: int) -> None:
        self.file, self.tensor, self.dtype, self.shape = file, tensor, dtype, shape
        self.first, self.rows, self.start, self.size = first, rows, start, size


NOTHING = Run("", "", "", [], 0, 0, 0, 0)


def runs(path: str, most: int) -> Iterator[Run]:
    begin, about = header(path)
    for name, entry in sorted(about.items(), key=lambda x: x[1]["data_offsets"]):
        shape, (lo, hi) = entry["shape"], entry["data_offsets"]
        rows = shape[0] if shape else 1
        width = (hi - lo) // rows if rows else 0
        step = max(1, most // width) if width else max(rows, 1)
        for first in range(0, max(rows, 1), step):
            n = min(step, rows - first)
            yield Run(path, name, entry["dtype"], shape, first, n, begin + lo + first * width, n * width)


def files_of(path: str) -> list[str]:
    """The safetensors files of a folder, or the one file, as given."""
    from pyarrow import fs as pafs

    fs, inner = store_of(path)
    if fs.get_file_info(inner).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in found if i.type == pafs.FileType.File and i.base_name.endswith(".safetensors"))


class TensorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.range = options["path"], int(options.get("range", RANGE))
        self.values = str(options.get("values", "true")).lower() == "true"
        self.wanted: dict[str, list[set]] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            kept = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if kept is not None and len(f.attribute) == 1 and f.attribute[0] in ("file", "tensor", "dtype"):
                self.wanted.setdefault(f.attribute[0], []).append(kept)
            else:
                yield f

    def _fits(self, r: Run) -> bool:
        return all(getattr(r, c) in kept for c, sets in self.wanted.items() for kept in sets)

    def partitions(self) -> list[Run]:
        files = [f for f in files_of(self.path) if all(f in kept for kept in self.wanted.get("file", []))]
        most = self.range if self.values else 1 << 62
        with ThreadPoolExecutor(16) as pool:
            found = [r for each in pool.map(lambda f: list(runs(f, most)), files) for r in each]
        return [r for r in found if self._fits(r)] or [NOTHING]

    def read(self, run: Run):
        import pyarrow as pa

        if not run.file:
            return
        values = None
        if self.values:
            fs, inner = store_of(run.file)
            with fs.open_input_file(inner) as f:
                data = f.read_at(run.size, run.start)
            if len(data) != run.size:
                raise ValueError(f"{run.file} ends inside {run.tensor}")
            values = decoded(data, run.dtype)
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        cells = (run.file, run.tensor, run.dtype, run.shape, run.first, run.rows)
        columns = [pa.array([v], t) for v, t in zip(cells, kinds, strict=True)]
        columns.append(pa.nulls(1, pa.list_(pa.float64())) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)))
        yield pa.RecordBatch.from_arrays(columns, ["file", "tensor", "dtype", "shape", "first", "rows", "values"])


class TensorSource(DataSource):
    """Options: path (a file or folder), range (bytes of a partition), values (false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))


def _scan(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorSource)
    return spark.read.format(FORMAT).option("path", path).options(**options).load()


def tensors(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """SCHEMA of the files' tensors, a row for each run of ``range_bytes`` at most."""
    return _scan(spark, path, range=range_bytes)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, tensor, dtype, shape) of every tensor; no data are read."""
    return _scan(spark, path, values="false").select("file", "tensor", "dtype", "shape")


def vectors(spark: SparkSession, path: str, tensor: str) -> DataFrame:
    """(file, row, v): the rows of a matrix, each an array of doubles."""
    t = tensors(spark, path).where(F.col("tensor") == tensor)
    width = F.aggregate(F.slice("shape", 2, F.size("shape")), F.lit(1).cast("bigint"), lambda a, n: a * n)
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1), lambda i: F.struct((F.col("first") + i).alias("row"), F.slice("values", (i * width + 1).cast("int"), width.cast("int")).alias("v")))
    return t.where("rows > 0").select("file", F.inline(each))


def write_vectors(rows: DataFrame, folder: str, dtype: str = "F32") -> DataFrame:
    """Writes rows (id, v) as safetensors files, one a partition: tensors ``ids`` (I64) and ``v``
    ([rows, numbers], F32 or F16 or F64); returns (file, rows).  A task that runs again writes
    its file anew under the same name, whole or not at all; the vectors of a partition are of
    one length."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, inner = store_of(folder)
        ids, values, width = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy().astype("<i8").tobytes())
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if width and len(v) != width * batch.num_rows or len(v) % batch.num_rows:
                    raise ValueError("vectors of several lengths")
                width = len(v) // batch.num_rows
                values.append(v.astype(KINDS[dtype]).tobytes())
        if not ids:
            return
        at = [0, *np.cumsum([sum(map(len, ids)), sum(map(len, values))]).tolist()]
        n = at[1] // 8
        about = {"ids": {"dtype": "I64", "shape": [n], "data_offsets": at[:2]}, "v": {"dtype": dtype, "shape": [n, width], "data_offsets": at[1:]}}
        head = json.dumps(about).encode()
        head += b" " * (-len(head) % 8)
        name = f"part-{TaskContext.get().partitionId():05d}.safetensors"
        fs.create_dir(inner, recursive=True)
        own = f"{inner}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            for part in (struct.pack("<Q", len(head)), head, *ids, *values):
                f.write(part)
        fs.move(own, f"{inner}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([n], pa.int64())], ["file", "rows"])

    return rows.select(F.col("id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(run, "file string, rows bigint")
