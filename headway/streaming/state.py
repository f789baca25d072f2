"""Vehicles' live state out of one stream's checkpoint and into another stream, and as the document that feeds exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Anchors of rest older than this are not carried over; places are, as an old place gives no speed anyway.
MAX_STILL_AGE_SEC = 6 * 3600.0
DOCUMENT = "still map<string, array<string>>, pos map<string, array<string>>"


def saved_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``vehicle_id, trip_id, t, dist_m, speed, still_t, still_dist_m`` as :func:`live.tracked` last committed them to ``checkpoint``."""
    return spark.read.format("statestore").load(checkpoint).select("key.vehicle_id", "value.groupState.*")


def aged(state: DataFrame, now: float, max_age: float = MAX_STILL_AGE_SEC) -> DataFrame:
    """State at its import: anchors of rest older than ``max_age`` go, places stay whatever their age; rows left with neither go."""
    fresh = F.lit(now) - F.col("still_t") <= max_age
    kept = state.withColumns({c: F.when(fresh, F.col(c)) for c in ("still_t", "still_dist_m")})
    return kept.where("still_t IS NOT NULL OR t IS NOT NULL")


def to_document(state: DataFrame) -> DataFrame:
    """``content``: one JSON text ``{"still": {vehicle: [t, dist_m, trip]}, "pos": {..}}``, vehicles in order.

    One row holds a whole fleet, some hundred bytes a vehicle; state itself is exchanged as a table instead where that is too much.
    """
    entry = lambda t, d: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(t).isNotNull(), F.struct("vehicle_id", F.array(F.col(t).cast("string"), F.col(d).cast("string"), F.col("trip_id")))))))
    return state.agg(F.to_json(F.struct(entry("still_t", "still_dist_m").alias("still"), entry("t", "dist_m").alias("pos"))).alias("content"))


def from_document(texts: DataFrame, unknown_speed: float = -1.0) -> DataFrame:
    """State of ``texts(content)`` as of :func:`to_document`. Entries that lack a number or the trip are skipped, and so is a text that isn't such a document.

    Speeds are not in the document and unknown. A vehicle whose place and rest are of different trips keeps the later one's.
    """
    read = texts.select(F.from_json("content", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))

    def entries(field: str, t: str, d: str) -> DataFrame:
        e = read.select(F.explode(F.col(f"d.{field}")).alias("vehicle_id", "e")).select("vehicle_id", F.get("e", F.lit(0)).try_cast("double").alias(t), F.get("e", F.lit(1)).try_cast("double").alias(d), F.get("e", F.lit(2)).alias(f"{field}_trip"))
        return e.dropna()

    both = entries("pos", "t", "dist_m").join(entries("still", "still_t", "still_dist_m"), "vehicle_id", "full")
    trip = F.when(F.col("t") >= F.col("still_t"), F.col("pos_trip")).otherwise(F.coalesce("still_trip", "pos_trip"))
    out = both.withColumn("trip_id", F.coalesce(trip, "pos_trip"))
    own = lambda field, c: F.when(F.col(f"{field}_trip") == F.col("trip_id"), F.col(c)).alias(c)
    return out.select("vehicle_id", "trip_id", own("pos", "t"), own("pos", "dist_m"), F.lit(unknown_speed).alias("speed"), own("still", "still_t"), own("still", "still_dist_m"))
