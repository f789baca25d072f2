"""Queries that write the engine's own formats and read them back, and their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from headway.models.trees import NUMERIC
from headway.operators import features as FE
from headway.operators import serving as SV
from headway.operators import trajectory as T
from headway.plans import testbed as B
from headway.plans.rounding import rounded_queries, rounded_sql
from headway.plans.scoring_queries import PRIORS_SQL, _rows
from headway.plans.serving_queries import VEHICLES_SQL, _timed_stops
from headway.plans.trajectory_queries import ORDERED_SQL, STATIONARY_SQL, TRIPS, with_
from headway.sources import bundle as BU
from headway.sources import snapshot_source as SS
from headway.sources.snapshots import encoded_feeds
from headway.staging import shared_folder

#: Seconds of the testbed's clock between two feeds, and the hour that is read.
POLL_SEC, WINDOW = 10, ("1970-02-02 21:00:00", "1970-02-02 21:59:59")


def snapshot_window(spark, sf_dir):
    """Fixes written as feed objects, one every POLL_SEC, and the vehicles of an hour read back by the objects' times."""
    f = B.fixes(spark, sf_dir)
    none = F.lit(None)
    feeds = encoded_feeds(
        f.select(
            (F.floor(F.col("t") / POLL_SEC) * POLL_SEC).alias("feed_ts"), "vehicle_id", "trip_id", "route_id", F.lit(49.5).alias("lat"), F.lit(24.25).alias("lon"), "bearing",
            none.cast("double").alias("speed"), none.cast("string").alias("stop_id"), none.cast("int").alias("current_status"), F.col("seq").alias("vehicle_ts"),
        )
    )
    path = f"{shared_folder(spark)}/headway-snapshots-{uuid.uuid4().hex}"
    SS.write_snapshots(feeds, path)
    return SS.read_snapshots(spark, path, *WINDOW).select("feed_ts", "vehicle_id", "trip_id", "route_id", "bearing", F.col("vehicle_ts").alias("seq"))


def vehicles(spark, sf_dir):
    """Fixes with the speed and rest that the live state would know."""
    return T.with_stationary(T.progress_speed(B.fixes(spark, sf_dir)))


def serving_tables(spark, sf_dir):
    """What a feed serves from, but for the model: timetable, lengths, priors, codes and the correction by horizon."""
    stops = _timed_stops(B.fixes(spark, sf_dir))
    rows = _rows(spark, sf_dir)
    biased = rows.groupBy("stops_ahead").agg(F.count("*").alias("n")).where("n > 0 AND stops_ahead % 3 <> 0")
    flat = biased.select(F.lit("flat").alias("kind"), "stops_ahead", (F.col("stops_ahead") * 3 - 5).cast("int").alias("bias_sec"))
    return {
        "stops": stops, "lengths": stops.groupBy("trip_id").agg(F.max("stop_dist_m").alias("length_m")), "priors": FE.route_hour_priors(rows),
        "codes": FE.ordinal_codes(rows), "bias": flat.unionByName(flat.where("stops_ahead <= 4").withColumns({"kind": F.lit("weekend"), "bias_sec": F.col("bias_sec") + 20})),
    }


def served_vector(spark, sf_dir):
    """All the model's inputs for each stop ahead of each fix."""
    t = serving_tables(spark, sf_dir)
    rows = SV.served_vector(vehicles(spark, sf_dir), t["stops"], t["lengths"], t["priors"], t["codes"])
    return rows.select("vehicle_id", "trip_id", "seq", "stop_id", "route_code", *FE.FEATURES)


#: Nodes of two trees over NUMERIC, so that SQL can say what they predict: (feature, threshold, left, right, is leaf, value).
_DISTANCE, _ETA, _REST, _LEAF = NUMERIC.index("remaining_dist_m"), NUMERIC.index("speed_eta_warm"), NUMERIC.index("stationary_sec"), lambda v: (0, 0.0, 0, 0, True, v)
TREES = [
    [(_DISTANCE, 400.0, 1, 2, False, 0.0), _LEAF(-60.5), (_ETA, 120.0, 3, 4, False, 0.0), _LEAF(15.25), _LEAF(90.0)],
    [(_REST, 0.0, 1, 2, False, 0.0), _LEAF(-4.0), _LEAF(7.5)],
]


def bundle_served(spark, sf_dir):
    """What a bundle serves that was written, read and checked: prediction, correction and seconds for each stop ahead."""
    path = f"{shared_folder(spark)}/headway-bundle-{uuid.uuid4().hex}"
    tables = {**serving_tables(spark, sf_dir), **BU.model_tables(spark, TREES, 200.0)}
    served = BU.write_bundle(spark, path, "2024-01-09", tables, date(2024, 1, 9)).serve(vehicles(spark, sf_dir))
    return served.select("vehicle_id", "trip_id", "seq", "stop_sequence", "predicted", "bias_sec", "seconds")


_QUERIES = {f.__name__: f for f in (snapshot_window, served_vector, bundle_served)}
_VECTOR_SQL = with_(*TRIPS, PRIORS_SQL, ORDERED_SQL, STATIONARY_SQL, VEHICLES_SQL, """ codes AS (SELECT route_id, row_number() OVER (ORDER BY route_id) - 1 AS code FROM (SELECT DISTINCT route_id FROM training)),
horizons AS (SELECT DISTINCT stops_ahead AS h FROM training WHERE stops_ahead % 3 <> 0),
served AS (SELECT *, CASE WHEN progress_speed_mps > 0 THEN progress_speed_mps ELSE hist_speed_mps END AS effective
  FROM (SELECT a.*, COALESCE(code, -1)::INT AS route_code, sp.progress_speed_mps, st.stationary_sec, COALESCE(p.speed, g.speed) AS hist_speed_mps, a.stops_ahead * COALESCE(p.sec_per_stop, g.sec_per_stop) AS hist_travel_time_est
        FROM ahead a JOIN speeds sp ON sp.seq = a.seq JOIN still st ON st.seq = a.seq LEFT JOIN codes c ON c.route_id = a.route_id LEFT JOIN priors p ON p.route_id = a.route_id AND p.hour = a.hour, (SELECT * FROM priors WHERE route_id IS NULL AND hour IS NULL) g)),
scored AS (SELECT *, (stop_dist_m - dist_m) / greatest(effective, 0.1) AS speed_eta_warm FROM served)""", recursive=True)  # fmt: skip
_SQL = {
    "snapshot_window": with_(B.FIXES_SQL)
    + f"""SELECT * FROM (SELECT (floor(t / {POLL_SEC}) * {POLL_SEC})::BIGINT AS feed_ts, vehicle_id, trip_id, route_id, bearing, seq FROM fixes)
          WHERE feed_ts BETWEEN epoch(TIMESTAMP '{WINDOW[0]}') AND epoch(TIMESTAMP '{WINDOW[1]}')""",
    "served_vector": _VECTOR_SQL
    + """SELECT vehicle_id, trip_id, seq, stop_id, route_code, route_id, stop_sequence, stops_ahead::INT AS stops_ahead, hour, (isodow(service_date) - 1)::INT AS day_of_week, month(service_date)::INT AS month, (isodow(service_date) >= 6)::INT AS is_weekend,
         (month(service_date) * 100 + day(service_date) IN (101, 107, 308, 501, 509, 628, 824, 1014, 1225))::INT AS is_holiday, stop_dist_m - dist_m AS remaining_dist_m, progress_speed_mps, stops_remaining::INT AS stops_remaining, stop_dist_m / 3900.0::DOUBLE AS trip_progress_frac,
         (stop_dist_m - dist_m) / stops_ahead AS dist_per_stop_m, speed_eta_warm, hist_speed_mps, hist_travel_time_est, stationary_sec FROM scored""",
    "bundle_served": _VECTOR_SQL
    + """, b AS (SELECT *, 200.0::DOUBLE + CASE WHEN stop_dist_m - dist_m <= 400 THEN -60.5 WHEN speed_eta_warm <= 120 THEN 15.25 ELSE 90 END::DOUBLE + CASE WHEN stationary_sec <= 0 THEN -4 ELSE 7.5 END::DOUBLE AS predicted,
           CASE WHEN isodow(service_date) >= 6 THEN (SELECT CASE WHEN stops_ahead IN (SELECT h FROM horizons WHERE h <= 4) THEN stops_ahead * 3 + 15 WHEN stops_ahead >= min(h) THEN max(h) * 3 + 15 ELSE 0 END FROM horizons WHERE h <= 4)
                ELSE (SELECT CASE WHEN stops_ahead IN (SELECT h FROM horizons) THEN stops_ahead * 3 - 5 WHEN stops_ahead >= min(h) THEN max(h) * 3 - 5 ELSE 0 END FROM horizons) END::INT AS bias_sec FROM scored)
       SELECT vehicle_id, trip_id, seq, stop_sequence, predicted, bias_sec, predicted - bias_sec AS seconds FROM b""",
}
_ROUNDED = {"served_vector": ["remaining_dist_m", "progress_speed_mps", "trip_progress_frac", "dist_per_stop_m", "speed_eta_warm", "hist_speed_mps", "hist_travel_time_est", "stationary_sec"], "bundle_served": ["predicted", "seconds"]}

QUERIES = rounded_queries(_QUERIES, _ROUNDED)
SQL = rounded_sql(_SQL, _ROUNDED)
