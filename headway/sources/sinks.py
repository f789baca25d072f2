"""Where results go: tables by day, reports, and the status beside a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.sources.snapshots import missing_days, with_default


def write_days(rows: DataFrame, path: str, day: str = "date", again: bool = False) -> DataFrame:
    """Write the days of ``rows`` that ``path`` lacks, all of them ``again`` if asked; returns the days written.

    Each day is a partition that is replaced as a whole, so a run that failed half-way is repeated without harm.
    """
    spark = rows.sparkSession
    days = rows.select(day).distinct()
    try:
        written = spark.read.parquet(path).select(day).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        written = days.limit(0)
    todo = days if again else missing_days(days, written, day)
    todo = spark.createDataFrame(todo.collect(), todo.schema)  # a run has some dozens of days; the table is about to change
    rows.join(F.broadcast(todo), day, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return todo


def add_column(path: str, target: str, spark, column: str, value, kind: str) -> bool:
    """Write ``path`` with a column that it lacks to ``target``; whether there was anything to do. The old table stays whole."""
    table = spark.read.parquet(path)
    if column in table.columns:
        return False
    with_default(table, column, value, kind).write.mode("overwrite").parquet(target)
    return True


def write_report(report: DataFrame, path: str, day: str = "date") -> None:
    """A JSON row for each day under ``day=..``, and the latest under ``latest``."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).json(f"{path}/days")
    last = report.agg(F.max(day).alias("last"))
    report.join(F.broadcast(last), F.col(day) == F.col("last"), "left_semi").coalesce(1).write.mode("overwrite").json(f"{path}/latest")


def write_events(events: DataFrame, path: str) -> None:
    """Off-route events and the like as CSV with a header."""
    events.write.mode("overwrite").csv(path, header=True)


def write_evaluation(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions of a comparison as Parquet, and its metrics as JSON beside them."""
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def status_writer(path: str, columns: tuple[str, ...] = ("feed_ts",)):
    """For ``foreachBatch``: the number of rows and the latest of ``columns`` of each batch, as JSON; a failure doesn't stop the feed."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            latest = [F.max(c).alias(c) for c in columns if c in batch.columns]
            batch.agg(F.count("*").alias("n"), *latest).withColumn("batch", F.lit(number)).coalesce(1).write.mode("overwrite").json(path)
        except Exception as e:
            print(f"status: {e}")

    return write
