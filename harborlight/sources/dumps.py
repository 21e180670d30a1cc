"""Provider dumps as a Spark data source: JSON lines under provider=.../day=.../ in a folder that every executor reaches.

    read_dumps(spark, folder).where("provider = 'x' and day >= '2024-01-01'")

The folder is listed once, on the driver, and only names cross over. With spark.sql.python.filterPushdown.enabled, filters on provider and day
are answered from the folders' names, so that no file of another provider or day is opened; without it Spark filters the rows. A file is read in pieces of piece_mb
that end with a line; a lost task is repeated from its piece alone. As a stream, files are taken by time of change and name; the offset is the last
one taken, so that it stays small whatever the number of files. A file must appear whole (written elsewhere, then moved) and is never changed.

Rows: provider, day, file, at (the line's place in the file), body. Blank lines are left out; a line that isn't UTF-8 has
replacement characters; an empty or missing folder has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, day string, file string, at long, body string"
#: Lines of an Arrow batch; bytes asked of the store at a time.
LINES, READ = 1000, 1 << 20
_PLACE = re.compile(r"(?:^|/)provider=([^/]*)/day=([^/]*)/[^/_.][^/]*$")


@dataclass(frozen=True)
class Dump:
    """One file: its address below the folder, place in time, size and what its folders say."""

    path: str
    changed: int
    size: int
    provider: str
    day: str


@dataclass
class Piece(InputPartition):
    """The lines that begin in [start, end) of a dump."""

    uri: str
    dump: Dump
    start: int
    end: int


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def dumps(uri: str) -> list[Dump]:
    from pyarrow import fs

    store, root = _store(uri)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    at = ((f, _PLACE.search(f.path)) for f in found if f.type == fs.FileType.File)
    return sorted((Dump(f.path, f.mtime_ns or 0, f.size, m[1], m[2]) for f, m in at if m), key=lambda d: (d.changed, d.path))


def pieces(uri: str, files: list[Dump], size: int) -> list[Piece]:
    return [Piece(uri, d, lo, min(lo + size, d.size)) for d in files for lo in range(0, d.size, size)]


def lines(piece: Piece) -> Iterator[pa.RecordBatch]:
    """A line belongs to the piece that holds its first byte."""
    store, _ = _store(piece.uri)
    with store.open_input_file(piece.dump.path) as f:
        at = max(piece.start - 1, 0)  # the byte before tells whether a line begins here
        f.seek(at)
        rest, skip, out = b"", piece.start > 0, []
        while at < piece.end:
            chunk = f.read(READ)
            parts = (rest + chunk).split(b"\n")
            rest = parts.pop()
            if not chunk:
                parts, rest = ([rest] if rest else []), b""
            for line in parts:
                if not skip and at < piece.end and line.strip():
                    out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                skip, at = False, at + len(line) + 1
                if len(out) >= LINES:
                    yield _batch(piece.dump, out)
                    out = []
            if not chunk:
                break
        if out:
            yield _batch(piece.dump, out)


def _batch(dump: Dump, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([dump.provider] * n), pa.array([dump.day] * n), pa.array([dump.path.rsplit("/", 1)[1]] * n), pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows])], names=["provider", "day", "file", "at", "body"])


_ANSWERS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
}


class DumpReader(DataSourceReader):
    def __init__(self, uri: str, size: int) -> None:
        self.uri, self.size, self.tests = uri, size, []

    def partitions(self) -> list[Piece]:
        held = [d for d in dumps(self.uri) if all(_ANSWERS[kind](getattr(d, name), value) for name, kind, value in self.tests)]
        return pieces(self.uri, held, self.size)

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        return lines(partition) if partition else iter(())


class PrunedDumpReader(DumpReader):
    """Answers filters on provider and day by itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _ANSWERS and f.attribute in (("provider",), ("day",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f


class DumpStream(DataSourceStreamReader):
    def __init__(self, uri: str, size: int) -> None:
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = dumps(self.uri)
        return {"changed": found[-1].changed, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return pieces(self.uri, [d for d in dumps(self.uri) if after < (d.changed, d.path) <= upto], self.size)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        """Dumps are kept."""


class ProviderDumps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_dumps"

    def schema(self) -> str:
        return SCHEMA

    def _place(self) -> tuple[str, int]:
        path = self.options.get("path")
        if not path:
            raise ValueError("option path is missing")
        return (path if "://" in path else f"file://{path}"), max(1, int(float(self.options.get("piece_mb", "64")) * (1 << 20)))

    def reader(self, schema) -> DumpReader:
        return (PrunedDumpReader if self.options.get("prune", "").lower() == "true" else DumpReader)(*self._place())

    def streamReader(self, schema) -> DumpStream:
        return DumpStream(*self._place())


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ProviderDumps)
    return spark.read.format("provider_dumps").option("prune", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(path)


def stream_dumps(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ProviderDumps)
    return spark.readStream.format("provider_dumps").load(path)
