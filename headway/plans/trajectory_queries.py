"""Queries over trajectories, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import trajectory as T
from headway.plans import testbed as B


def _fixes(spark, sf_dir):
    return B.fixes(spark, sf_dir)


def _rows(spark, sf_dir, stationary: bool = False):
    f = T.progress_speed(_fixes(spark, sf_dir))
    if stationary:
        f = T.with_stationary(f)
    return T.training_rows(f, B.stops(f), horizon=B.HORIZON_SEC)


def _statuses(spark, sf_dir):
    return T.off_route_status(_fixes(spark, sf_dir).withColumn("bearing_diff", F.abs(F.col("bearing") - 180)))


def progress_speed(spark, sf_dir):
    return T.progress_speed(_fixes(spark, sf_dir)).select("vehicle_id", "trip_id", "seq", "progress_speed_mps")


def stationary_seconds(spark, sf_dir):
    return T.stationary_seconds(_fixes(spark, sf_dir))


def constrained_progress(spark, sf_dir):
    """Over the fixes' own jumps: ``value`` metres from the origin of each fix, which neither is monotone nor slow."""
    return T.constrained_progress(_fixes(spark, sf_dir).withColumn("dist_m", F.col("off_m") * 2))


def stop_crossings(spark, sf_dir):
    f = _fixes(spark, sf_dir)
    return T.stop_crossings(f, B.stops(f))


def training_rows(spark, sf_dir):
    cols = ["vehicle_id", "trip_id", "route_id", "seq", "t", "dist_m", "progress_speed_mps", "stationary_sec", "stop_id", "stop_sequence", "stop_dist_m", "stops_ahead", "stops_remaining", "actual_arrival", "seconds_to_arrival"]
    return _rows(spark, sf_dir, True).select(*cols)


def labels(spark, sf_dir):
    f = _fixes(spark, sf_dir)
    s = B.stops(f)
    start = f.groupBy("trip_id").agg(F.min("t").alias("t0"))
    schedule = s.join(start, "trip_id").select("trip_id", "stop_sequence", (F.col("t0") + F.col("stop_sequence") * 60.0).alias("scheduled_arrival"))
    out = T.labels(T.stop_crossings(f, s), schedule, "Europe/Kyiv")
    return out.select("vehicle_id", "trip_id", "stop_sequence", "actual_arrival", "scheduled_arrival", "delay_sec", "hour", "day_of_week")


def dwell_events(spark, sf_dir):
    f = _fixes(spark, sf_dir)
    return T.dwell_events(f, B.stops(f))


def dwell_by_type(spark, sf_dir):
    return T.dwell_table(dwell_events(spark, sf_dir), B.route_types(spark, sf_dir), least=5)


def offroute_status(spark, sf_dir):
    return _statuses(spark, sf_dir)


def offroute_episodes(spark, sf_dir):
    return T.off_route_episodes(_statuses(spark, sf_dir))


def status_segments(spark, sf_dir):
    return T.status_segments(_statuses(spark, sf_dir)).select("vehicle_id", F.col("segment").cast("long").alias("segment"), "off_route", "first_t", "last_t", "n")


SPEEDS_SQL = """
lagged AS (SELECT *, lag(t) OVER w AS t0, lag(dist_m) OVER w AS d0, max(dist_m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
           FROM fixes WINDOW w AS (PARTITION BY vehicle_id, trip_id ORDER BY t, seq)),
speeds AS (SELECT *, CASE WHEN t - t0 BETWEEN 3 AND 120 AND dist_m - d0 >= -30 THEN greatest(0.0::DOUBLE, dist_m - d0) / (t - t0) ELSE -1.0::DOUBLE END AS progress_speed_mps FROM lagged)"""
CROSSINGS_SQL = """
crossings AS (
  SELECT vehicle_id, f.trip_id, route_id, stop_id, stop_sequence, stop_dist_m,
         CASE WHEN dist_m > d0 THEN t0 + (stop_dist_m - d0) / (dist_m - d0) * (t - t0) ELSE t END AS actual_arrival
  FROM lagged f JOIN stops s ON s.trip_id = f.trip_id AND stop_dist_m > COALESCE(reached, '-inf'::DOUBLE) AND stop_dist_m <= dist_m)"""
ORDERED_SQL = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id, trip_id ORDER BY t, seq) AS rn FROM fixes)"""
STATIONARY_SQL = """
still AS (
  SELECT vehicle_id, trip_id, seq, rn, t AS at, dist_m AS ad, 0.0::DOUBLE AS stationary_sec FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.vehicle_id, o.trip_id, o.seq, o.rn, CASE WHEN o.dist_m - s.ad > 25 THEN o.t ELSE s.at END, CASE WHEN o.dist_m - s.ad > 25 THEN o.dist_m ELSE s.ad END,
         CASE WHEN o.dist_m - s.ad > 25 THEN 0.0::DOUBLE ELSE o.t - s.at END
  FROM still s JOIN ordered o ON o.vehicle_id = s.vehicle_id AND o.trip_id = s.trip_id AND o.rn = s.rn + 1)"""
TRAINING_SQL = """
near AS (
  SELECT f.vehicle_id, f.trip_id, f.route_id, f.service_date, f.hour, f.seq, f.t, f.dist_m, f.progress_speed_mps, c.stop_id, c.stop_sequence, c.stop_dist_m, c.actual_arrival,
         c.actual_arrival - f.t AS seconds_to_arrival, row_number() OVER o AS stops_ahead, max(CASE WHEN c.actual_arrival - f.t > 600 THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS far
  FROM speeds f JOIN crossings c ON c.vehicle_id = f.vehicle_id AND c.trip_id = f.trip_id AND c.stop_dist_m > f.dist_m AND c.actual_arrival >= f.t
  WINDOW o AS (PARTITION BY f.vehicle_id, f.trip_id, f.seq ORDER BY c.stop_dist_m, c.stop_sequence)),
training AS (SELECT * EXCLUDE (far, stops_ahead), stops_ahead::INT AS stops_ahead, (39 - stop_sequence)::INT AS stops_remaining FROM near WHERE far = 0 AND stops_ahead <= 10)"""
STATUS_SQL = """
signals AS (
  SELECT vehicle_id, seq, t, off_m, row_number() OVER w AS rn,
         off_m > 150 OR (abs(bearing - 180) > 90 AND off_m > 50) OR COALESCE(off_m > lag(off_m) OVER w AND lag(off_m) OVER w > lag(off_m, 2) OVER w AND off_m > 100, false) AS looks_off
  FROM fixes WINDOW w AS (PARTITION BY vehicle_id ORDER BY t, seq)),
folded AS (
  SELECT vehicle_id, rn, seq, t, false AS off_route, CASE WHEN looks_off THEN 1 ELSE 0 END AS n FROM signals WHERE rn = 1
  UNION ALL
  SELECT s.vehicle_id, s.rn, s.seq, s.t, CASE WHEN q.k >= 3 THEN NOT f.off_route ELSE f.off_route END, CASE WHEN q.k >= 3 THEN 0 ELSE q.k END
  FROM folded f JOIN signals s ON s.vehicle_id = f.vehicle_id AND s.rn = f.rn + 1,
       LATERAL (SELECT CASE WHEN (f.off_route AND s.off_m <= 100) OR (NOT f.off_route AND s.looks_off) THEN f.n + 1 ELSE 0 END AS k) q)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n"


TRIPS = (B.FIXES_SQL, B.STOPS_SQL, SPEEDS_SQL, CROSSINGS_SQL, TRAINING_SQL)

QUERIES = {f.__name__: f for f in (progress_speed, stationary_seconds, constrained_progress, stop_crossings, training_rows, labels, dwell_events, dwell_by_type, offroute_status, offroute_episodes, status_segments)}

DWELL_SQL = """
moves AS (SELECT *, CASE WHEN dist_m - lag(dist_m) OVER w >= 8 THEN 1 ELSE 0 END AS moving, lead(t) OVER w AS next_t, count(*) OVER (PARTITION BY vehicle_id, trip_id) AS n_fixes
          FROM fixes WINDOW w AS (PARTITION BY vehicle_id, trip_id ORDER BY t, seq)),
runs AS (SELECT *, sum(moving) OVER (PARTITION BY vehicle_id, trip_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM moves),
rests AS (SELECT vehicle_id, trip_id, route_id, run, max(t) - min(t) + (arg_max(COALESCE(next_t, 'inf'::DOUBLE), seq) - max(t)) AS dwell_sec, avg(dist_m) AS here
          FROM runs WHERE n_fixes >= 3 GROUP BY vehicle_id, trip_id, route_id, run HAVING count(*) >= 2 AND arg_max(COALESCE(next_t, 'inf'::DOUBLE), seq) < 'inf'::DOUBLE),
dwells AS (SELECT vehicle_id, trip_id, route_id, dwell_sec FROM rests r
           WHERE dwell_sec > 0 AND dwell_sec <= 180 AND EXISTS (SELECT 1 FROM range(0, 40) q(k) WHERE abs(k * 100.0::DOUBLE - here) <= 40))"""

SQL = {
    "progress_speed": with_(B.FIXES_SQL, SPEEDS_SQL) + "SELECT vehicle_id, trip_id, seq, progress_speed_mps FROM speeds",
    "stationary_seconds": with_(B.FIXES_SQL, ORDERED_SQL, STATIONARY_SQL, recursive=True) + "SELECT vehicle_id, trip_id, seq, stationary_sec FROM still",
    "constrained_progress": with_(
        B.FIXES_SQL,
        """
o AS (SELECT vehicle_id, trip_id, seq, t, off_m * 2 AS d, row_number() OVER w AS rn, lead(off_m * 2) OVER w AS nxt FROM fixes WINDOW w AS (PARTITION BY vehicle_id, trip_id ORDER BY t, seq)),
c AS (SELECT vehicle_id, trip_id, seq, rn, t, d AS dist_m FROM o WHERE rn = 1
      UNION ALL
      SELECT o.vehicle_id, o.trip_id, o.seq, o.rn, o.t,
             CASE WHEN o.d <= c.dist_m + 40.0::DOUBLE * greatest(o.t - c.t, 0) THEN greatest(o.d, c.dist_m) WHEN o.nxt >= (c.dist_m + o.d) / 2 THEN o.d
                  ELSE greatest(least(o.d, c.dist_m + 40.0::DOUBLE * greatest(o.t - c.t, 0)), c.dist_m) END
      FROM c JOIN o ON o.vehicle_id = c.vehicle_id AND o.trip_id = c.trip_id AND o.rn = c.rn + 1)""",
        recursive=True,
    )
    + "SELECT vehicle_id, trip_id, seq, dist_m FROM c",
    "stop_crossings": with_(B.FIXES_SQL, B.STOPS_SQL, SPEEDS_SQL, CROSSINGS_SQL) + "SELECT * FROM crossings",
    "training_rows": with_(*TRIPS, ORDERED_SQL, STATIONARY_SQL, recursive=True)
    + "SELECT t.* EXCLUDE (service_date, hour), stationary_sec FROM training t JOIN still s ON s.vehicle_id = t.vehicle_id AND s.trip_id = t.trip_id AND s.seq = t.seq",
    "labels": with_(B.FIXES_SQL, B.STOPS_SQL, SPEEDS_SQL, CROSSINGS_SQL, " starts AS (SELECT trip_id, min(t) AS t0 FROM fixes GROUP BY trip_id)")
    + """SELECT vehicle_id, c.trip_id, stop_sequence, actual_arrival, t0 + stop_sequence * 60.0::DOUBLE AS scheduled_arrival, actual_arrival - (t0 + stop_sequence * 60.0::DOUBLE) AS delay_sec,
         hour(make_timestamp(((floor(actual_arrival))::BIGINT) * 1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv')::INT AS hour, (isodow(make_timestamp(floor(actual_arrival)::BIGINT * 1000000)) - 1)::INT AS day_of_week
       FROM crossings c JOIN starts s ON s.trip_id = c.trip_id""",
    "dwell_events": with_(B.FIXES_SQL, DWELL_SQL) + "SELECT * FROM dwells",
    "dwell_by_type": with_(B.FIXES_SQL, DWELL_SQL, B.ROUTE_TYPES_SQL, " typed AS (SELECT d.*, route_type FROM dwells d LEFT JOIN route_types r ON r.route_id = d.route_id)")
    + """SELECT route_type::VARCHAR AS route_type, count(*) AS n, quantile_cont(dwell_sec, 0.5) AS dwell_sec FROM typed WHERE route_type IS NOT NULL GROUP BY route_type HAVING count(*) >= 5
         UNION ALL SELECT '_global', count(*), quantile_cont(dwell_sec, 0.5) FROM typed""",
    "offroute_status": with_(B.FIXES_SQL, STATUS_SQL, recursive=True) + "SELECT vehicle_id, seq, t, off_route FROM folded",
    "offroute_episodes": with_(B.FIXES_SQL, STATUS_SQL, recursive=True)
    + """, turns AS (SELECT *, COALESCE(off_route <> lag(off_route) OVER (PARTITION BY vehicle_id ORDER BY t, seq), true) AS changed FROM folded),
       ends AS (SELECT *, lead(t) OVER (PARTITION BY vehicle_id ORDER BY t, seq) AS off_end FROM turns WHERE changed)
       SELECT vehicle_id, t AS off_start, off_end, (off_end - t) / 60 AS duration_min FROM ends WHERE off_route""",
    "status_segments": with_(B.FIXES_SQL, STATUS_SQL, recursive=True)
    + """, turns AS (SELECT *, CASE WHEN COALESCE(off_route <> lag(off_route) OVER (PARTITION BY vehicle_id ORDER BY t, seq), true) THEN 1 ELSE 0 END AS changed FROM folded),
       segs AS (SELECT *, sum(changed) OVER (PARTITION BY vehicle_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS segment FROM turns)
       SELECT vehicle_id, segment::BIGINT AS segment, off_route, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM segs GROUP BY ALL""",
}
