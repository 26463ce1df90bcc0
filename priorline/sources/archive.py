"""An archive of snapshots in folders by day and slot as a source of its own, for batches and for streams.

    spark.dataSource.register(archive.SnapshotArchive)
    spark.read.format("snapshot_archive").load("/archive").where("day = '2024-01-05'")
    spark.readStream.format("snapshot_archive").load("/archive")

Layout: day=YYYY-MM-DD/slot=K/*.json, JSON lines with ``at`` and ``minutes_``. A batch has a partition for each file of the days
that the filters leave. A stream's offset is the last folder that was read, in order of day and slot; a folder has to be whole
when it appears. Workers open the files themselves, so the archive has to lie where all of them reach it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "at long, minutes_ long, day string, slot int, file string"


class _File(InputPartition):
    def __init__(self, path: str, day: str, slot: int) -> None:
        self.path, self.day, self.slot = path, day, slot


class _Archive:
    """The folders of an archive and the rows of a file."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")

    def files(self) -> list[_File]:
        fs, base = self._open()
        found = []
        for x in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)):
            parts = x.path.split("/")
            if x.is_file and x.base_name.endswith(".json") and not x.base_name.startswith(("_", ".")) and parts[-3].startswith("day=") and parts[-2].startswith("slot="):
                found.append(_File(x.path, parts[-3][4:], int(parts[-2][5:])))
        return sorted(found, key=lambda f: (f.day, f.slot, f.path))

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = self._open()
        with fs.open_input_stream(partition.path) as stream:
            for line in stream.read().decode().splitlines():
                if line:
                    row = json.loads(line)
                    yield row.get("at"), row.get("minutes_"), partition.day, partition.slot, partition.path.rsplit("/", 1)[-1]


class ArchiveReader(DataSourceReader, _Archive):
    def __init__(self, options: dict) -> None:
        _Archive.__init__(self, options)
        self._days: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the day choose folders; Spark keeps the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("day",):
                self._days.append(f)
            else:
                yield f

    def _holds(self, day: str) -> bool:
        said = {EqualTo: lambda v: day == v, In: lambda v: day in v, GreaterThan: lambda v: day > v, GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v, LessThanOrEqual: lambda v: day <= v}
        return all(said[type(f)](f.value) for f in self._days)

    def partitions(self) -> list[_File]:
        return [f for f in self.files() if self._holds(f.day)] or [_File("", "", -1)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _Archive.read(self, partition) if partition.path else iter(())


class ArchiveStream(DataSourceStreamReader, _Archive):
    """Offsets depend on the folders alone, so that a query that starts again goes on where it was."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    @staticmethod
    def _name(f: _File) -> str:
        return f"{f.day}/{f.slot:04d}"

    def latestOffset(self) -> dict:
        return {"after": max((self._name(f) for f in self.files()), default="")}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [f for f in self.files() if start["after"] < self._name(f) <= end["after"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _Archive.read(self, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done."""


class SnapshotArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options)
