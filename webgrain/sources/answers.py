"""A store of captured answers as a Spark data source: ``spark.read.format("answers").load(folder)`` once ``register(spark)`` was called."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "provider string, request bigint, fetched_at timestamp, body string"
_ARROW = pa.schema([("provider", pa.string()), ("request", pa.int64()), ("fetched_at", pa.timestamp("us", tz="UTC")), ("body", pa.string())])
#: A file is closed beyond so many bytes of bodies; rows are gathered up to so many before they are written.
FILE_BYTES, GROUP_BYTES = 64 << 20, 4 << 20


@dataclass
class File:
    """A committed file: rows of one provider, and the times between which they were fetched (microseconds; null if all are null)."""

    name: str
    provider: str | None
    first: int | None
    last: int | None
    rows: int


@dataclass
class Part(InputPartition):
    file: File


@dataclass
class Written(WriterCommitMessage):
    files: list[File]


class Answers(DataSource):
    """Rows ``provider, request, fetched_at, body`` in a folder that driver and executors share.

    Files hold one provider each and count once a commit lists them, so an unfinished or
    failed write is never seen. Filters on provider and time leave out files before they
    are read (``spark.sql.python.filterPushdown.enabled``); what is left is filtered by
    row. As a stream, offsets are numbers of commits, and each file is read once.
    Writes append; one writer at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswersReader:
        return AnswersReader(self.options["path"])

    def streamReader(self, schema) -> AnswersStream:
        return AnswersStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> AnswersWriter:
        if overwrite:
            raise ValueError("answers are appended, not overwritten")
        wanted = [f.name for f in _ARROW]
        if sorted(schema.names) != sorted(wanted):
            raise ValueError(f"answers have the columns {', '.join(wanted)}")
        return AnswersWriter(self.options["path"])


class Store:
    """The folder: files, and in ``_commits`` one list of files for each write."""

    def __init__(self, path: str):
        self.path = path

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def commits(self) -> list[str]:
        where, root = self.opened()
        found = where.get_file_info(fs.FileSelector(posixpath.join(root, "_commits"), allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json"))

    def files(self, first: int = 0, last: int | None = None) -> list[File]:
        where, _ = self.opened()
        out = []
        for path in self.commits()[first:last]:
            with where.open_input_stream(path) as f:
                out += [File(**x) for x in json.loads(f.read())]
        return out

    def add(self, files: list[File]) -> None:
        """Commit files: the list is written under another name and then moved, so it is there whole or not at all."""
        where, root = self.opened()
        folder = posixpath.join(root, "_commits")
        where.create_dir(folder, recursive=True)
        draft = posixpath.join(root, f"_draft-{uuid.uuid4().hex}")
        with where.open_output_stream(draft) as f:
            f.write(json.dumps([vars(x) for x in files]).encode())
        where.move(draft, posixpath.join(folder, f"{len(self.commits()):012d}.json"))

    def keep(self, folder: str, files: set[str]) -> None:
        """Remove all else from a write's folder, and the folder if nothing stays."""
        where, root = self.opened()
        at = posixpath.join(root, folder)
        for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f"{folder}/{f.base_name}" not in files:
                where.delete_file(f.path)
        if not files and where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        where, root = self.opened()
        with where.open_input_file(posixpath.join(root, name)) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=1024, columns=[c.name for c in _ARROW])


def _micros(value: datetime) -> int:
    value = value if value.tzinfo else value.astimezone()
    since = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


class AnswersReader(DataSourceReader):
    def __init__(self, path: str):
        self.store = Store(path)
        self.providers: set[str] | None = None
        self.first: int | None = None
        self.last: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Provider filters are met by whole files and so are settled; time filters leave out files and go on to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("provider",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.providers = asked if self.providers is None else self.providers & asked
                continue
            if f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual) and f.attribute == ("fetched_at",):
                self.first = max(self.first if self.first is not None else _micros(f.value), _micros(f.value))
            if f.__class__ in (EqualTo, LessThan, LessThanOrEqual) and f.attribute == ("fetched_at",):
                self.last = min(self.last if self.last is not None else _micros(f.value), _micros(f.value))
            yield f

    def _asked(self, f: File) -> bool:
        if self.providers is not None and (f.provider is None or f.provider not in self.providers):
            return False
        if self.first is None and self.last is None:
            return True
        return f.first is not None and (self.first is None or f.last >= self.first) and (self.last is None or f.first <= self.last)

    def partitions(self) -> list[Part]:
        return [Part(f) for f in self.store.files() if self._asked(f)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.store.batches(partition.file.name)


class AnswersStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.store = Store(path)

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": len(self.store.commits())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(f) for f in self.store.files(start["commit"], end["commit"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.store.batches(partition.file.name)

    def commit(self, end: dict) -> None:
        """Nothing is to be kept: offsets are in the query's checkpoint."""


class AnswersWriter(DataSourceWriter):
    """Each write has a folder of its own, so that what lost or failed tasks left can be removed without a message from them."""

    def __init__(self, path: str):
        self.store = Store(path)
        self.folder = f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        """Write a task's rows, one open file for each provider."""
        where, root = self.store.opened()
        where.create_dir(posixpath.join(root, self.folder), recursive=True)
        open_: dict[str | None, _Open] = {}
        done: list[File] = []
        for row in iterator:
            p = row["provider"]
            if p not in open_:
                open_[p] = _Open(where, root, self.folder, p)
            open_[p].add(row)
            if open_[p].size > FILE_BYTES:
                done.append(open_.pop(p).closed())
        while open_:
            done.append(open_.popitem()[1].closed())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        self.store.keep(self.folder, {f.name for f in files})
        if files:
            self.store.add(files)

    def abort(self, messages: list[Written | None]) -> None:
        self.store.keep(self.folder, set())


class _Open:
    """A file that is being written."""

    def __init__(self, where: fs.FileSystem, root: str, folder: str, provider: str | None):
        self.file = File(f"{folder}/part-{uuid.uuid4().hex}.parquet", provider, None, None, 0)
        self.writer = pq.ParquetWriter(where.open_output_stream(posixpath.join(root, self.file.name)), _ARROW)
        self.rows: list[dict] = []
        self.size = self.held = 0

    def add(self, row) -> None:
        at = row["fetched_at"]
        if at is not None:
            at = _micros(at)
            self.file.first = at if self.file.first is None else min(self.file.first, at)
            self.file.last = at if self.file.last is None else max(self.file.last, at)
        self.rows.append({"provider": row["provider"], "request": row["request"], "fetched_at": at, "body": row["body"]})
        self.file.rows += 1
        self.held += len(row["body"] or "") + 64
        if self.held > GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.writer.write_table(pa.Table.from_pylist(self.rows, schema=_ARROW))
        self.size += self.held
        self.rows, self.held = [], 0

    def closed(self) -> File:
        self.flush()
        self.writer.close()
        return self.file


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.dataSource.register(Answers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
