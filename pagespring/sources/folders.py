"""A folder's files as rows, by a Python data source: listed first, read afterwards.

Planning lists the folder, not its subfolders, and sorts the names; partitions are runs of that
order of PART bytes at most, so rows come in path order and no content is ever shuffled to sort
it.  Hidden names (those with ``_`` or ``.`` in front) are files like others.  As a stream, a
micro-batch holds the files that came since the last one, by (time of change, path).

Defined results: a file that cannot be read, or is gone by then, and an entry that is neither
file nor folder, are rows with their error and no content; a link to nothing is not listed; a missing folder and an empty one give no rows; an empty file has empty content.
In a stream a file that is put there with a time before that of the last one seen is not seen.
"""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .store import store_of

FORMAT = "pagespring_folder"
SCHEMA = "path string, name string, length bigint, modified bigint, content binary, status string, error string"
PART = 64 << 20
FILES = 1000  # of a partition, where they are small


class Files(InputPartition):
    """(path, name, length, modified) of a run of files in path order."""

    def __init__(self, files: list[tuple[str, str, int, int]]) -> None:
        self.files = files


def listed(folder: str, globs: list[str]) -> list[tuple[str, str, int, int]]:
    """(path, name, length, time of change in ns) of a folder's entries whose name fits, sorted;
    the length is -1 for what is neither a file nor a folder."""
    from pyarrow import fs as pafs

    fs, inner = store_of(folder)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return []
    found = [i for i in fs.get_file_info(pafs.FileSelector(inner)) if i.type != pafs.FileType.Directory]
    fits = [i for i in found if not globs or any(fnmatch(i.base_name.lower(), g) for g in globs)]
    top = folder.rstrip("/")
    return sorted((f"{top}/{i.base_name}", i.base_name, i.size if i.type == pafs.FileType.File else -1, i.mtime_ns or 0) for i in fits)


def parts(files: list[tuple[str, str, int, int]], most: int) -> list[Files]:
    out: list[list] = []
    size = 0
    for f in files:
        if not out or size + max(f[2], 0) > most or len(out[-1]) >= FILES:
            out.append([])
            size = 0
        out[-1].append(f)
        size += max(f[2], 0)
    return [Files(x) for x in out]


class _Reading:
    def __init__(self, options: dict) -> None:
        self.folder, self.part = options["path"], int(options.get("part", PART))
        self.globs = [g for g in str(options.get("globs", "")).lower().split(",") if g]
        self.content = str(options.get("content", "true")).lower() == "true"

    def read(self, part: Files):
        for path, name, length, modified in part.files:
            content, status, error = None, "ok", None
            if length < 0:  # to open a pipe would wait for ever
                length, status, error = None, "failed", "not a regular file"
            elif self.content:
                try:
                    fs, inner = store_of(path)
                    with fs.open_input_stream(inner) as f:
                        content = f.read()
                except OSError as e:
                    status, error = "failed", str(e)
            yield (path, name, length, modified, content, status, error)


class FolderReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return parts(listed(self.folder, self.globs), self.part) or [Files([])]


class FolderStream(_Reading, DataSourceStreamReader):
    """An offset is the (time, path) of the last file of a batch."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder, self.globs)
        modified, path = max(((m, p) for p, _, _, m in files), default=(-1, ""))
        return {"modified": modified, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = ((o["modified"], o["path"]) for o in (start, end))
        return parts([f for f in listed(self.folder, self.globs) if lo < (f[3], f[0]) <= hi], self.part)


class FolderSource(DataSource):
    """Options: path, globs (lower-case, parted by commas), part (bytes), content (false: names only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(dict(self.options))


def folder(spark: SparkSession, path: str, globs: str = "", content: bool = True, part: int = PART) -> DataFrame:
    """SCHEMA of a folder's files, in path order."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FORMAT).options(path=path, globs=globs, content=str(content).lower(), part=part).load()


def arriving(spark: SparkSession, path: str, globs: str = "") -> DataFrame:
    """The same as a stream of the files that come."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format(FORMAT).options(path=path, globs=globs).load()
