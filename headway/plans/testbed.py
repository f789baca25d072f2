"""Transit tables derived from the ``events`` and ``nation`` tables, in integer arithmetic that any SQL engine repeats.

``fixes``: a vehicle's position along its route. ``stops``: a stop every 100 m. Times are epoch seconds as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STOP_SPACING_CM, STOPS_PER_TRIP = 10_000, 40
HORIZON_SEC = 600.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vehicle_id, trip_id, route_id, service_date, hour, seq, t, dist_m, off_m, bearing``."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("trip_no", F.expr("datediff(ts, DATE'2024-01-01') div 10"))
    run = Window.partitionBy("user_id", "trip_no").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("trip_no").cast("string")).alias("trip_id"),
        (F.col("user_id") % 25).cast("string").alias("route_id"),
        F.to_date("ts").alias("service_date"),
        F.hour("ts").alias("hour"),
        F.col("event_id").alias("seq"),
        (F.expr("unix_micros(ts) div 600000") / 1000.0).alias("t"),
        (F.sum(F.round(F.col("value") * 100).cast("long")).over(run) / 100.0).alias("dist_m"),
        (F.col("value") * 4).alias("off_m"),
        F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double").alias("bearing"),
    )


FIXES_SQL = """
fixes AS (
  SELECT user_id::VARCHAR AS vehicle_id, user_id::VARCHAR || '-' || (date_diff('day', TIMESTAMP '2024-01-01', ts) // 10)::VARCHAR AS trip_id,
         (user_id % 25)::VARCHAR AS route_id, ts::DATE AS service_date, hour(ts)::INT AS hour, event_id AS seq, (epoch_us(ts) // 600000) / 1000.0::DOUBLE AS t,
         sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) // 10 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT / 100.0::DOUBLE AS dist_m,
         value * 4 AS off_m, ((event_id * 37) % 360)::DOUBLE AS bearing
  FROM events)"""


def stops(fixes: DataFrame) -> DataFrame:
    """``trip_id, stop_id, stop_sequence, stop_dist_m``, the same stops for every trip."""
    trips = fixes.select("trip_id").distinct()
    return trips.select("trip_id", F.explode(F.sequence(F.lit(0), F.lit(STOPS_PER_TRIP - 1))).alias("stop_sequence")).select(
        "trip_id", F.concat(F.lit("s"), F.col("stop_sequence").cast("string")).alias("stop_id"), "stop_sequence", (F.col("stop_sequence") * (STOP_SPACING_CM / 100.0)).alias("stop_dist_m")
    )


STOPS_SQL = """
stops AS (SELECT trip_id, 's' || k::VARCHAR AS stop_id, k::INT AS stop_sequence, k * 100.0::DOUBLE AS stop_dist_m
          FROM (SELECT DISTINCT trip_id FROM fixes), range(0, 40) r(k))"""


def route_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``route_id, route_type``: trams, buses and trolleybuses by the nation's region."""
    n = read(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") % 3 == 0, 0).when(F.col("n_regionkey") % 3 == 1, 3).otherwise(11)
    return n.select(F.col("n_nationkey").cast("string").alias("route_id"), kind.alias("route_type"))


ROUTE_TYPES_SQL = """
route_types AS (SELECT n_nationkey::VARCHAR AS route_id, CASE n_regionkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 11 END AS route_type FROM nation)"""
