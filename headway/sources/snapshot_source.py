"""Folders of snapshot objects as a Spark data source: ``spark.read.format("snapshots")`` opens only the objects whose time a filter asks for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from headway.sources import wire

NAME = "snapshots"
OBJECTS = "path string, key_ts timestamp, content binary"
ROWS = f"path string, key_ts timestamp, {wire.VEHICLES}"
#: Bytes of objects in a partition, and objects, whichever comes first.
PARTITION_BYTES, PARTITION_OBJECTS = 32 << 20, 2000


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets it see filters, which Spark leaves off unless asked."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Snapshots)


def instant_of(name: str) -> datetime | None:
    """The UTC instant in an object's name ``<ISO time>.pb``; None if there is none."""
    try:
        at = datetime.fromisoformat(name.removesuffix(".pb"))
    except ValueError:
        return None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def day_of(folder: str) -> date | None:
    """The day of a folder ``date=YYYY-MM-DD`` or ``YYYY-MM-DD``; None for other folders."""
    found = re.fullmatch(r"(?:date=)?(\d{4}-\d\d-\d\d)", folder)
    try:
        return date.fromisoformat(found[1]) if found else None
    except ValueError:
        return None


@dataclass
class Keys(InputPartition):
    """Objects that follow one another by time: ``(path, time)``."""

    objects: list[tuple[str, datetime | None]]


class Snapshots(DataSource):
    """``path, key_ts`` and the vehicles of each object, or its bytes with option ``kind`` = ``objects``.

    Options: ``path``; ``kind`` (``vehicles``, ``objects``); ``mode`` (``PERMISSIVE``: objects that can't be decoded or were
    deleted since they were listed give no rows, ``FAILFAST``: they fail the job; other read errors always do, so that Spark
    runs the task again); ``absent`` as in the codec. Paths are those that pyarrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return OBJECTS if self.options.get("kind") == "objects" else ROWS

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SnapshotWriter:
        if overwrite:
            raise ValueError("snapshots are only appended; an object of the same time replaces the old one")
        if not {"feed_ts", "content"} <= set(schema.names):
            raise ValueError("snapshots are written from the columns feed_ts and content")
        return SnapshotWriter(self.options["path"])


class SnapshotReader(DataSourceReader):
    """Bounds on ``key_ts`` prune day folders before they are listed, and objects before they are opened.

    Every filter is also left to Spark, so that pruning may be coarse. The list of the objects in range is held by the
    driver, as for Spark's own file sources.
    """

    def __init__(self, options: dict):
        self.options = options
        self.low: datetime | None = None
        self.high: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("key_ts",):
                value = getattr(f, "value", None)
                if isinstance(f, IsNotNull):
                    self.low = self.low or datetime.min.replace(tzinfo=UTC)
                elif isinstance(value, datetime):
                    at = value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)
                    if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                        self.low = max(self.low or at, at)
                    if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                        self.high = min(self.high or at, at)
            yield f

    def _wanted(self, at: datetime | None) -> bool:
        if at is None:
            return self.low is None and self.high is None
        return (self.low is None or at >= self.low) and (self.high is None or at <= self.high)

    def _wanted_day(self, day: date | None) -> bool:
        """A folder's day may be that of any time zone, so a day on either side counts."""
        if day is None:
            return True
        one = timedelta(days=1)
        return (self.low is None or self.low.date() <= date.min + one or day >= self.low.date() - one) and (self.high is None or day <= self.high.date() + one)

    def partitions(self) -> list[Keys]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.options["path"])
        found, todo = [], [top]
        while todo:
            for info in store.get_file_info(fs.FileSelector(todo.pop())):
                if info.type == fs.FileType.Directory:
                    if not info.base_name.startswith(("_", ".")) and self._wanted_day(day_of(info.base_name)):
                        todo.append(info.path)
                elif info.base_name.endswith(".pb") and not info.base_name.startswith(("_", ".")):
                    at = instant_of(info.base_name)
                    if self._wanted(at):
                        found.append((at is None, at, info.path, info.size or 0))
        out, objects, held = [], [], 0
        for _, at, path, size in sorted(found, key=lambda x: (x[0], x[1] or datetime.min.replace(tzinfo=UTC), x[2])):
            if objects and (held + size > int(self.options.get("partitionbytes", PARTITION_BYTES)) or len(objects) >= PARTITION_OBJECTS):
                out.append(Keys(objects))
                objects, held = [], 0
            objects.append((path, at))
            held += size
        return [*out, Keys(objects)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.options["path"])
        strict, absent = self.options.get("mode") == "FAILFAST", self.options.get("absent", "default")
        for path, at in partition.objects:
            try:
                with store.open_input_stream(path) as file:
                    content = file.read()
                if self.options.get("kind") == "objects":
                    yield path, at, content
                    continue
                rows = wire.decode_vehicles(content, absent)
            except (FileNotFoundError, ValueError, TypeError, AttributeError):
                if strict:
                    raise
                continue
            for row in rows:
                yield path, at, *row


@dataclass
class Written(WriterCommitMessage):
    objects: int


class SnapshotWriter(DataSourceArrowWriter):
    """An object ``date=YYYY-MM-DD/YYYYMMDDTHHMMSSZ.pb`` for each row, by its ``feed_ts``.

    Objects are written beside and renamed, and named by their time: a task that is run again, or twice at once, leaves the
    same objects. One of a job that failed may stay; the job run again replaces it. Rows without time or content are skipped.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        n = 0
        for batch in iterator:
            for ts, content in zip(batch.column("feed_ts").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if ts is None or content is None:
                    continue
                at = datetime.fromtimestamp(ts, UTC)
                folder = f"{top}/date={at:%Y-%m-%d}"
                store.create_dir(folder, recursive=True)
                beside = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as file:
                    file.write(content)
                store.move(beside, f"{folder}/{at:%Y%m%dT%H%M%SZ}.pb")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        pass


def read_snapshots(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, **options: str) -> DataFrame:
    """The source's rows, from ``start`` to ``end`` inclusive by the objects' times; sort by ``timestamp, vehicle_id`` where an order is wanted."""
    register(spark)
    rows = spark.read.format(NAME).options(**options).load(path)
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            rows = rows.where(f"key_ts {op} TIMESTAMP '{bound}'")
    return rows


def write_snapshots(feeds: DataFrame, path: str) -> None:
    """Writes ``feeds(feed_ts, content)``, one row for each time, as objects."""
    register(feeds.sparkSession)
    feeds.select("feed_ts", "content").write.format(NAME).mode("append").save(path)
