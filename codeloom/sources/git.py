"""Git repositories as a data source: spark.read.format("git") and, by commits, spark.readStream.format("git").

Options: repo (a folder that all executors see), branch (a branch, tag or commit; HEAD), blobs (blobs of one task). A planner lists the
tree once, a filter on the path is pushed into the listing, and tasks read the contents of their blobs from git by one process each. Nothing is
checked out. A stream's offset is a commit: a batch holds what changed between two of them.
"""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .files import _blobs, _git
from .store import ship

SCHEMA = "path string, content string, blob string, size bigint, change string, modified_time timestamp"
_ARROW = pa.schema([("path", pa.string()), ("content", pa.string()), ("blob", pa.string()), ("size", pa.int64()), ("change", pa.string()), ("modified_time", pa.timestamp("us", tz="UTC"))])
#: Blobs of one task.
BLOBS = 256
#: The commit before the first.
NOTHING = ""


@dataclass
class Blobs(InputPartition):
    """(path, blob, change) of the files that a task reads, and the time of their commit."""

    files: list[tuple[str, str | None, str]]
    at: str


def _cut(files: list[tuple[str, str | None, str]], at: str, n: int) -> list[Blobs]:
    return [Blobs(files[i : i + n], at) for i in range(0, len(files), n)] or [Blobs([], at)]


def _tree(repo: str, commit: str) -> dict[str, str]:
    """The blobs of a commit by their path."""
    if commit == NOTHING:
        return {}
    rows = (x.split("\t", 1) for x in _git(repo, "ls-tree", "-r", "-z", commit).split("\0") if x)
    return {p: m.split()[2] for m, p in rows if m.split()[1] == "blob"}


def _time(repo: str, commit: str) -> str:
    return _git(repo, "log", "-1", "--pretty=%cI", commit).strip() if commit != NOTHING else "1970-01-01T00:00:00+00:00"


def _contents(repo: str, part: Blobs) -> Iterator[pa.RecordBatch]:
    at = datetime.datetime.fromisoformat(part.at)
    there = [b for _, b, _ in part.files if b]
    data = dict(zip(there, _blobs(repo, there), strict=True)) if there else {}
    rows = [{"path": p, "content": data[b].decode(errors="replace") if b else None, "blob": b, "size": len(data[b]) if b else None, "change": c, "modified_time": at} for p, b, c in part.files]
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.branch, self.n = options["repo"], options.get("branch", "HEAD"), int(options.get("blobs", BLOBS))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes filters on the path; the rest goes back to Spark."""
        tests = {EqualTo: lambda p, v: p == v, StringEndsWith: str.endswith, StringStartsWith: str.startswith, StringContains: lambda p, v: v in p}
        for f in filters:
            if type(f) in tests and f.attribute == ("path",):
                self.tests.append((tests[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Blobs]:
        files = [(p, b, "added") for p, b in _tree(self.repo, self.branch).items() if all(t(p, v) for t, v in self.tests)]
        return _cut(files, _time(self.repo, self.branch), self.n)

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        return _contents(self.repo, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.branch, self.n = options["repo"], options.get("branch", "HEAD"), int(options.get("blobs", BLOBS))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": NOTHING}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": _git(self.repo, "rev-parse", self.branch).strip()}

    def partitions(self, start: dict, end: dict) -> list[Blobs]:
        old, new = _tree(self.repo, start["commit"]), _tree(self.repo, end["commit"])
        files = [(p, b, "modified" if p in old else "added") for p, b in new.items() if old.get(p) != b] + [(p, None, "deleted") for p in old if p not in new]
        return _cut(files, _time(self.repo, end["commit"]), self.n)

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        return _contents(self.repo, partition)


class Git(DataSource):
    """path, content (null: the file went), blob, size, change (added, modified, deleted), modified_time (of the commit)."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Git)
