"""Connectors: byte-stream sources and sinks behind Spark's Python Data Source API, with errors that say whether to retry.

A FileSource lists objects and opens them; `register` makes it a Spark format whose partitions are the objects, so
reading is spread over executors. The local-folder connector is complete; stores with Hadoop file systems
(s3a, gs) need none, and SFTP needs a client library that is not installed here.
"""

from __future__ import annotations

import io
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import MaskError


class TransientError(MaskError):
    """May succeed if tried again."""


class PermanentError(MaskError):
    """Won't succeed however often it is tried."""


@dataclass(frozen=True)
class Capabilities:
    list: bool = True
    head: bool = True
    read: bool = True
    write: bool = False
    multipart: bool = False
    atomic: bool = False


class FileSource(ABC):
    capabilities = Capabilities()

    @abstractmethod
    def list(self, prefix: str = "") -> list[str]: ...

    @abstractmethod
    def open(self, name: str) -> io.BufferedIOBase: ...

    def head(self, name: str, size: int = 1024) -> bytes:
        with self.open(name) as f:
            return f.read(size)

    def check(self) -> None:
        self.list()


class FileSink(ABC):
    capabilities = Capabilities(write=True)

    @abstractmethod
    def write(self, name: str, data: bytes) -> None: ...

    def check(self) -> None:
        self.write(".check", b"")


class LocalFolder(FileSource, FileSink):
    """Objects of a folder that driver and executors both see. Writes are whole: a temporary name, then a rename."""

    capabilities = Capabilities(write=True, atomic=True)

    def __init__(self, path: str):
        self.path = path

    def place(self, name: str) -> Path:
        p = (Path(self.path) / name).resolve()
        if not p.is_relative_to(Path(self.path).resolve()):
            raise PermanentError("path_outside_folder", name)
        return p

    def list(self, prefix: str = "") -> list[str]:
        root = Path(self.path)
        if not root.is_dir():
            raise PermanentError("folder_missing", self.path)
        return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and str(p.relative_to(root)).startswith(prefix) and not p.name.startswith((".", "_")))

    def open(self, name: str) -> io.BufferedIOBase:
        try:
            return self.place(name).open("rb")
        except FileNotFoundError:
            raise PermanentError("object_missing", name) from None
        except OSError as e:
            raise TransientError("object_unreadable", str(e)) from None

    def write(self, name: str, data: bytes) -> None:
        p = self.place(name)
        p.parent.mkdir(parents=True, exist_ok=True)
        part = p.with_name(f".{p.name}.part")
        part.write_bytes(data)
        part.replace(p)


@dataclass
class ObjectPartition(InputPartition):
    name: str


class LineReader(DataSourceReader):
    def __init__(self, source: FileSource, prefix: str):
        self.source, self.prefix = source, prefix

    def partitions(self):
        return [ObjectPartition(n) for n in self.source.list(self.prefix)]

    def read(self, partition: ObjectPartition) -> Iterator[tuple]:
        with self.source.open(partition.name) as f:
            for i, line in enumerate(io.TextIOWrapper(f, "utf-8")):
                yield partition.name, i, line.rstrip("\n")


@dataclass
class Written(WriterCommitMessage):
    name: str


class LineWriter(DataSourceWriter):
    """Each task writes one object of its rows' last column, a line each; names come from the task, so a retry replaces its own."""

    def __init__(self, sink: FileSink, prefix: str):
        self.sink, self.prefix = sink, prefix

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        name = f"{self.prefix}part-{TaskContext.get().partitionId():05d}.txt"
        self.sink.write(name, "".join(f"{r[-1]}\n" for r in rows).encode())
        return Written(name)

    def commit(self, messages) -> None:
        self.sink.write(f"{self.prefix}_SUCCESS", b"")

    def abort(self, messages) -> None:
        pass


class LineSource(DataSource):
    """Format `sparkmask_lines`: (object, line_no, line) of a folder's text objects. Options: path, prefix."""

    @classmethod
    def name(cls) -> str:
        return "sparkmask_lines"

    def schema(self) -> str:
        return "object string, line_no long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(LocalFolder(self.options["path"]), self.options.get("prefix", ""))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(LocalFolder(self.options["path"]), self.options.get("prefix", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineSource)


def retried(run, times: int = 3):
    """run(), again after transient errors."""
    for i in range(times):
        try:
            return run()
        except TransientError:
            if i == times - 1:
                raise
