"""Daily quality reports read back from their JSON files, as the rows that calibration pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "map<string,struct<n:double,mae_sec:double,bias_sec:double>>"
REPORT = f"date string, status string, by_stops_ahead {CELLS}, by_stops_ahead_weekend map<string,{CELLS}>"


def report_files(spark: SparkSession, path: str, days: int, since: str | None = None) -> DataFrame:
    """``date, report`` of the latest ``days`` files ``YYYY-MM-DD.json`` from ``since`` on.

    Files are taken by their names before any is looked into, so that one that can't be read, or that tells of a failed
    run, uses up one of the days. Other names (``latest.json``) aren't reports of a day. Only the files taken are opened.
    """
    context = spark.sparkContext
    pattern = context._jvm.org.apache.hadoop.fs.Path(f"{path}/????-??-??.json")
    names = sorted(str(f.getPath()) for f in pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern) or [])
    latest = [n for n in names if not since or n.rsplit("/", 1)[1][:10] >= since][-days:]
    if not latest:
        return spark.createDataFrame([], f"date string, report struct<{', '.join(c.replace(' ', ':', 1) for c in REPORT.split(', '))}>")
    texts = spark.read.text(latest, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.json$", 1).alias("date"), "value")
    return texts.select("date", F.from_json("value", REPORT).alias("report"))


def quality_reports(spark: SparkSession, path: str, days: int, since: str | None = None, by_day: bool = False) -> DataFrame:
    """``date, status, stops_ahead, n, mae_sec, bias_sec`` of the reports that are ok, a row a horizon; ``by_day``: of each kind of day, ``day``.

    Horizons that aren't whole numbers are left out, as are cells without a count.
    """
    ok = report_files(spark, path, days, since).where("report.status = 'ok' AND size(report.by_stops_ahead) > 0")
    if by_day:
        cells = ok.select("date", "report.status", F.explode("report.by_stops_ahead_weekend").alias("day", "cells")).select("date", "status", "day", F.explode("cells").alias("h", "m"))
    else:
        cells = ok.select("date", "report.status", F.explode("report.by_stops_ahead").alias("h", "m"))
    kind = ["day"] if by_day else []
    return cells.select("date", "status", *kind, F.expr("try_cast(h AS int)").alias("stops_ahead"), F.col("m.n").cast("long").alias("n"), "m.mae_sec", "m.bias_sec").where("stops_ahead IS NOT NULL AND n IS NOT NULL")
