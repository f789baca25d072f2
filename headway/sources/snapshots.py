"""Snapshot objects, feeds and schedules as DataFrames, and feeds back to objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.sources import wire


def key_instant(name):
    """The instant in an object's name ``<ISO time>.pb``, with or without punctuation; null if there is none."""
    text = F.regexp_extract(name, r"([^/]*)\.pb$", 1)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")))


def snapshot_files(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``path, key_ts, content`` of the objects below a folder, from ``start`` to ``end`` inclusive by the time in their names.

    Folders named ``date=...`` are partitions and prune by themselves. Names without a time go only when a range is asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pb").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", key_instant(F.col("path")).alias("key_ts"), "content")
    if start:
        files = files.where(F.col("key_ts") >= F.lit(start).cast("timestamp"))
    if end:
        files = files.where(F.col("key_ts") <= F.lit(end).cast("timestamp"))
    return files


def _decoded(files: DataFrame, decode: Callable[[bytes], list[tuple]], schema: str, mode: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows: list[tuple] = []
            for data in pdf["content"]:
                try:
                    rows += decode(bytes(data or b""))
                except (ValueError, TypeError, AttributeError):
                    if mode == "FAILFAST":
                        raise
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(names)})

    return files.select("content").mapInPandas(run, schema)


def vehicle_positions(files: DataFrame, mode: str = "PERMISSIVE", absent: str = "default") -> DataFrame:
    """Vehicle rows of each object; unreadable ones give none, or fail the job in mode FAILFAST."""
    return _decoded(files, lambda data: wire.decode_vehicles(data, absent), wire.VEHICLES, mode).withColumn("timestamp", F.timestamp_seconds("feed_ts"))


def predictions(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    return _decoded(files, wire.decode_predictions, wire.PREDICTIONS, mode)


def in_order(positions: DataFrame) -> DataFrame:
    """Vehicle rows by ``timestamp`` and vehicle: a range sort, for who wants one file after another in order."""
    return positions.withColumn("timestamp", F.timestamp_seconds("feed_ts")).orderBy("timestamp", "vehicle_id")


def encoded_feeds(rows: DataFrame, kind: str = "vehicles") -> DataFrame:
    """``feed_ts, content``: a message for each feed time, entities in the order of the vehicles.

    Entities are encoded row by row; a feed's are gathered, a fleet at one moment.
    """
    encode = wire.encode_vehicle if kind == "vehicles" else wire.encode_trip_update

    def entities(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            clean = pdf.astype(object).where(pdf.notna(), None)
            for c in ("current_status", "vehicle_ts", "congestion_level", "timestamp", "delay"):
                if c in clean:
                    clean[c] = [None if v is None else int(v) for v in clean[c]]
            yield pd.DataFrame({"feed_ts": pdf["feed_ts"], "vehicle_id": pdf["vehicle_id"], "entity": [encode(r) for r in clean.to_dict("records")]})

    each = rows.mapInPandas(entities, "feed_ts long, vehicle_id string, entity binary")
    fleets = each.groupBy("feed_ts").agg(F.array_sort(F.collect_list(F.struct("vehicle_id", "entity"))).alias("e"))

    def messages(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"feed_ts": pdf["feed_ts"], "content": [wire.encode_feed(int(t), [x["entity"] for x in e]) for t, e in zip(pdf["feed_ts"], pdf["e"], strict=True)]})

    return fleets.mapInPandas(messages, "feed_ts long, content binary")


REQUIRED = ("stop_times", "trips", "routes", "stops")


def schedule_tables(spark: SparkSession, folder: str, file: str = "{}.txt", multi_line: bool = False) -> dict[str, DataFrame]:
    """The tables of an unpacked static feed, all columns as strings; required ones must have rows, others may be missing.

    Quotes within a quoted field are doubled. Line feeds within one need ``multi_line``, which reads a file in one task.
    """
    out = {}
    for name in (*REQUIRED, "shapes", "calendar", "calendar_dates", "agency"):
        try:
            table = spark.read.csv(f"{folder}/{file.format(name)}", header=True, inferSchema=False, escape='"', multiLine=multi_line)
            if name in REQUIRED and table.isEmpty():
                raise ValueError(f"{name} has no rows")
        except Exception as e:
            if name in REQUIRED:
                raise ValueError(f"{name}: {e}") from e
            continue
        out[name] = table
    return out


def schedule_zip(spark: SparkSession, archive: str, folder: str, block: int = 1 << 20) -> dict[str, DataFrame]:
    """The tables of a zipped static feed, from anywhere that Spark reads; its members are unpacked to ``folder``, which executors must see.

    One archive is one row of ``binaryFile``; its members are read as streams and written in blocks of whole records, each
    member's in their order, so that neither the driver nor a task holds a member as a whole. Line ends become line feeds.
    """

    def members(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa

        def batch_of(name: str, i: int, lines: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array(["".join(lines).removesuffix("\n")])], ["name", "i", "value"])

        for batch in batches:
            for data in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".txt")):
                        base, i, held, size, open_quote = name.rsplit("/", 1)[-1], 0, [], 0, False
                        with io.TextIOWrapper(z.open(name), "utf-8-sig") as lines:
                            for line in lines:
                                held.append(line)
                                size += len(line)
                                open_quote ^= line.count('"') % 2 == 1
                                if size >= block and not open_quote:
                                    yield batch_of(base, i, held)
                                    i, held, size = i + 1, [], 0
                        if held:
                            yield batch_of(base, i, held)

    blocks = spark.read.format("binaryFile").load(archive).select("content").mapInArrow(members, "name string, i long, value string")
    blocks.repartition("name").sortWithinPartitions("name", "i").select("name", "value").write.mode("overwrite").partitionBy("name").text(folder)
    return schedule_tables(spark, folder, "name={}.txt", multi_line=True)


def agency_timezone(agency: DataFrame, default: str = "UTC") -> str:
    """The feed's time zone; one that isn't known counts as missing."""
    from zoneinfo import ZoneInfo

    row = agency.select("agency_timezone").where("agency_timezone IS NOT NULL").first() if "agency_timezone" in agency.columns else None
    try:
        return ZoneInfo(row[0].strip()).key if row else default
    except (KeyError, ValueError, OSError):
        return default


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of features by its suffix: Parquet, else CSV with a header."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def missing_days(days: DataFrame, written: DataFrame, day: str = "date") -> DataFrame:
    """The days of a run that aren't written yet."""
    return days.join(written.select(day).distinct(), day, "left_anti")


def with_default(df: DataFrame, column: str, value, kind: str) -> DataFrame:
    """Adds a column that older files lack."""
    return df if column in df.columns else df.withColumn(column, F.lit(value).cast(kind))
