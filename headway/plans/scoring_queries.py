"""Queries for features, scoring and calibration, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import calibration as C
from headway.operators import features as FE
from headway.operators import scoring as S
from headway.operators import trajectory as T
from headway.plans import testbed as B
from headway.plans.rounding import rounded_queries, rounded_sql
from headway.plans.trajectory_queries import ORDERED_SQL, STATIONARY_SQL, TRIPS, with_
from headway.staging import written

ZONE = "Europe/Kyiv"


def _rows(spark, sf_dir):
    """Training rows, written once, as priors, predictions and scores all start from them."""
    f = T.progress_speed(B.fixes(spark, sf_dir))
    return written(T.training_rows(f, B.stops(f), horizon=B.HORIZON_SEC), "training-rows")


def _primed(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return FE.apply_priors(rows, FE.route_hour_priors(rows))


def _predictions(spark, sf_dir):
    """What a feed at the schedule-free ETA would have served: fixes far off the route aren't."""
    rows = _primed(spark, sf_dir).where("off_m <= 150")
    return rows.select(F.floor("t").alias("feed_ts"), "vehicle_id", "trip_id", "route_id", "stop_id", "stop_sequence", "stops_ahead", F.floor(F.col("t") + F.col("speed_eta_warm")).alias("predicted_arrival"))


def _actuals(spark, sf_dir):
    f = B.fixes(spark, sf_dir)
    return T.stop_crossings(f, B.stops(f)).select("vehicle_id", "trip_id", "route_id", "stop_id", "stop_sequence", F.floor("actual_arrival").alias("actual_arrival_ts"))


def _both_sides(spark, sf_dir):
    """Predictions and actuals, each written once, for what meets them several times."""
    return written(_predictions(spark, sf_dir), "predictions"), written(_actuals(spark, sf_dir), "actuals")


def _joined(spark, sf_dir):
    bounds = B.fixes(spark, sf_dir).groupBy("trip_id").agg(F.floor(F.min("t")).alias("start_ts"), F.floor(F.max("t")).alias("end_ts"))
    return S.residuals(_predictions(spark, sf_dir), _actuals(spark, sf_dir), ZONE, bounds)


def route_hour_priors(spark, sf_dir):
    return FE.route_hour_priors(_rows(spark, sf_dir))


def apply_priors(spark, sf_dir):
    return _primed(spark, sf_dir).select("vehicle_id", "trip_id", "seq", "stop_sequence", "effective_speed_mps", "speed_eta_warm", "hist_travel_time_est")


def features(spark, sf_dir):
    f = T.with_stationary(T.progress_speed(B.fixes(spark, sf_dir)))
    rows = written(T.training_rows(f, B.stops(f), horizon=B.HORIZON_SEC), "training-rows")
    lengths = B.stops(f).groupBy("trip_id").agg(F.max("stop_dist_m").alias("length_m"))
    rows = FE.progress_features(FE.calendar_features(FE.apply_priors(rows, FE.route_hour_priors(rows))), lengths)
    rows = FE.with_codes(rows, FE.ordinal_codes(rows))
    return rows.select("vehicle_id", "trip_id", "seq", "route_code", *FE.FEATURES, "seconds_to_arrival")


def sane_rows(spark, sf_dir):
    return FE.sane(_rows(spark, sf_dir), excluded=("3", "7")).groupBy("route_id").agg(F.count("*").alias("n"), F.max("seconds_to_arrival").alias("longest"))


def sample_weights(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("hour").agg(F.sum(FE.sample_weight(F.col("hour"))).alias("weight"))


def uncertainty_by_horizon(spark, sf_dir):
    return FE.uncertainty_by_horizon(_primed(spark, sf_dir), "speed_eta_warm")


def score_by_axis(spark, sf_dir):
    return S.score_by_axis(_joined(spark, sf_dir))


def score_overall(spark, sf_dir):
    return _joined(spark, sf_dir).where("kept").agg(*S.metrics())


def score_drop_counts(spark, sf_dir):
    return S.drop_counts(_joined(spark, sf_dir))


def arriving_now(spark, sf_dir):
    return S.arriving_now(_joined(spark, sf_dir))


def coverage_strict(spark, sf_dir):
    return S.strict_coverage(*_both_sides(spark, sf_dir))


def physical_stop_coverage(spark, sf_dir):
    return S.physical_coverage(*_both_sides(spark, sf_dir))


def nearest_prediction(spark, sf_dir):
    return S.nearest_prediction(*_both_sides(spark, sf_dir))


def coverage_gap_causes(spark, sf_dir):
    return S.gap_counts(S.coverage_gaps(*_both_sides(spark, sf_dir), ZONE))


def coverage_gaps_by_route(spark, sf_dir):
    return S.gap_counts(S.coverage_gaps(*_both_sides(spark, sf_dir), ZONE), "route_id", 20)


def coverage_gaps_by_hour(spark, sf_dir):
    return S.gap_counts(S.coverage_gaps(*_both_sides(spark, sf_dir), ZONE), "hour")


def worst_routes(spark, sf_dir):
    return S.worst_routes(written(_joined(spark, sf_dir), "residuals"))


def worst_predictions(spark, sf_dir):
    return S.worst_predictions(_joined(spark, sf_dir))


def _daily(spark, sf_dir, *by):
    """Daily metrics by horizon, the service date being the day of the report; weekends by that date."""
    rows = _primed(spark, sf_dir).withColumn("error", F.col("speed_eta_warm") - F.col("seconds_to_arrival"))
    day = F.when(F.weekday("service_date") >= 5, "weekend").otherwise("weekday")
    rows = rows.select(F.col("service_date").alias("date"), day.alias("day"), "stops_ahead", "route_id", "error")
    return rows.groupBy("date", *by).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae_sec"), F.avg("error").alias("bias_sec")).withColumn("status", F.lit("ok"))


def pooled_mae(spark, sf_dir):
    return C.live_uncertainty(_daily(spark, sf_dir, "stops_ahead"), 7)


def pooled_bias(spark, sf_dir):
    return C.live_bias(_daily(spark, sf_dir, "stops_ahead"), 7, "2024-01-20")


def pooled_bias_by_day(spark, sf_dir):
    return C.live_bias(_daily(spark, sf_dir, "day", "stops_ahead"), 14, by=("day",))


def bias_accumulate(spark, sf_dir):
    d = written(_daily(spark, sf_dir, "stops_ahead"), "daily")
    return C.accumulate_bias(C.pooled_bias(d.where("date < '2024-01-16'")), C.pooled_bias(d.where("date >= '2024-01-16'")))


def weekend_merge(spark, sf_dir):
    d = written(_daily(spark, sf_dir, "day", "stops_ahead"), "daily")
    # a date is of one kind, so its cells are those without the kind
    flat = C.pooled_bias(d.drop("day")).withColumn("bias_sec", F.round("bias_sec").cast("long"))
    live = C.pooled_bias(d.where("date < '2024-01-16' AND stops_ahead <= 6"), ("day",), 20).withColumn("bias_sec", F.round("bias_sec").cast("long"))
    residual = C.pooled_bias(d.where("date >= '2024-01-16' AND stops_ahead <= 3"), ("day",), 20)
    return C.merge_bias(flat, live.drop("n"), residual.drop("n"))


def route_digest_delta(spark, sf_dir):
    return C.route_digest(_daily(spark, sf_dir, "route_id"))


PRIORS_SQL = """
cells AS (SELECT route_id, hour, grouping(route_id) AS g, quantile_cont(CASE WHEN progress_speed_mps > 0 THEN progress_speed_mps END, 0.5) AS speed, quantile_cont(seconds_to_arrival / stops_ahead, 0.5) AS sec_per_stop
          FROM training GROUP BY GROUPING SETS ((route_id, hour), ())),
whole AS (SELECT COALESCE(speed, 5.0) AS g_speed, COALESCE(sec_per_stop, 40.0) AS g_per_stop FROM cells WHERE g = 1),
priors AS (SELECT route_id, hour, COALESCE(speed, g_speed) AS speed, COALESCE(sec_per_stop, g_per_stop) AS sec_per_stop FROM cells, whole),
primed0 AS (SELECT t.*, CASE WHEN progress_speed_mps > 0 THEN progress_speed_mps ELSE COALESCE(p.speed, g_speed) END AS effective_speed_mps, COALESCE(p.speed, g_speed) AS hist_speed_mps, stops_ahead * COALESCE(p.sec_per_stop, g_per_stop) AS hist_travel_time_est
            FROM training t CROSS JOIN whole LEFT JOIN priors p ON p.route_id = t.route_id AND p.hour = t.hour),
primed AS (SELECT *, greatest(0.0::DOUBLE, stop_dist_m - dist_m) / greatest(effective_speed_mps, 0.1::DOUBLE) AS speed_eta_warm FROM primed0)"""
SERVED_SQL = """
predictions AS (SELECT floor(p.t)::BIGINT AS feed_ts, p.vehicle_id, p.trip_id, p.route_id, stop_id, stop_sequence, stops_ahead, floor(p.t + speed_eta_warm)::BIGINT AS predicted_arrival
                FROM primed p JOIN fixes f ON f.vehicle_id = p.vehicle_id AND f.seq = p.seq WHERE off_m <= 150),
actuals AS (SELECT vehicle_id, trip_id, route_id, stop_id, stop_sequence, floor(actual_arrival)::BIGINT AS actual_arrival_ts FROM crossings)"""
JOINED_SQL = """
bounds AS (SELECT trip_id, floor(min(t))::BIGINT AS start_ts, floor(max(t))::BIGINT AS end_ts FROM fixes GROUP BY trip_id),
joined0 AS (SELECT p.*, a.actual_arrival_ts, predicted_arrival - actual_arrival_ts AS error_sec, abs(predicted_arrival - actual_arrival_ts) AS abs_error_sec, predicted_arrival - feed_ts AS lead_sec,
                   make_timestamp(feed_ts * 1000000) AS fed, feed_ts BETWEEN start_ts - 7200 AND end_ts + 7200 AS on_schedule
            FROM predictions p JOIN actuals a USING (vehicle_id, trip_id, stop_id, stop_sequence) JOIN bounds b ON b.trip_id = p.trip_id),
joined AS (SELECT *, hour(fed AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv') AS hour, isodow(fed) >= 6 AS is_weekend, lead_sec > 0 AS forward, abs_error_sec <= 3600 AS plausible,
                  CASE WHEN lead_sec < 120 THEN '0-2m' WHEN lead_sec < 300 THEN '2-5m' WHEN lead_sec < 600 THEN '5-10m' WHEN lead_sec < 1200 THEN '10-20m' ELSE '20m+' END AS lead_bucket FROM joined0),
kept AS (SELECT *, CASE WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day FROM joined WHERE forward AND plausible AND on_schedule)"""
METRICS_SQL = "count(*) AS n, avg(error_sec) AS bias_sec, avg(abs_error_sec) AS mae_sec, quantile_cont(abs_error_sec, 0.5)::DOUBLE AS median_ae_sec, quantile_cont(abs_error_sec, 0.9)::DOUBLE AS p90_ae_sec"
GAPS_SQL = """
tagged AS (SELECT a.*, hour(make_timestamp(actual_arrival_ts * 1000000) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv')::INT AS hour,
  CASE WHEN EXISTS (SELECT 1 FROM predictions p WHERE p.vehicle_id = a.vehicle_id AND p.trip_id = a.trip_id AND p.stop_id = a.stop_id AND p.stop_sequence = a.stop_sequence) THEN 'covered'
       WHEN NOT EXISTS (SELECT 1 FROM predictions p WHERE p.vehicle_id = a.vehicle_id) THEN 'vehicle_absent'
       WHEN NOT EXISTS (SELECT 1 FROM predictions p WHERE p.vehicle_id = a.vehicle_id AND p.trip_id = a.trip_id) THEN 'trip_mismatch' ELSE 'stop_missing' END AS cause FROM actuals a)"""
GAP_COUNTS_SQL = """count(*) AS n_actual, count_if(cause <> 'covered')::BIGINT AS n_uncovered, count_if(cause = 'vehicle_absent')::BIGINT AS vehicle_absent, count_if(cause = 'trip_mismatch')::BIGINT AS trip_mismatch,
  count_if(cause = 'stop_missing')::BIGINT AS stop_missing, count_if(cause = 'covered') / count(*) AS coverage_frac FROM tagged"""
DAILY_SQL = """
errors AS (SELECT service_date AS date, CASE WHEN isodow(service_date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day, stops_ahead, route_id, speed_eta_warm - seconds_to_arrival AS e FROM primed)"""
_served = with_(*TRIPS, PRIORS_SQL, SERVED_SQL)
_joined_sql = with_(*TRIPS, PRIORS_SQL, SERVED_SQL, JOINED_SQL)
_daily_sql = with_(*TRIPS, PRIORS_SQL, DAILY_SQL)


def _axis(name, key, group, day=False):
    return f"SELECT '{name}' AS axis, {key} AS key, {METRICS_SQL} FROM kept" + (f" GROUP BY {group}" if group else "")


QUERIES = {
    f.__name__: f
    for f in (
        route_hour_priors, apply_priors, features, sane_rows, sample_weights, uncertainty_by_horizon, score_by_axis, score_overall, score_drop_counts, arriving_now, coverage_strict, physical_stop_coverage, nearest_prediction,
        coverage_gap_causes, coverage_gaps_by_route, coverage_gaps_by_hour, worst_routes, worst_predictions, pooled_mae, pooled_bias, pooled_bias_by_day, bias_accumulate, weekend_merge, route_digest_delta,
    )
}

SQL = {
    "route_hour_priors": with_(*TRIPS, PRIORS_SQL) + "SELECT * FROM priors",
    "apply_priors": with_(*TRIPS, PRIORS_SQL) + "SELECT vehicle_id, trip_id, seq, stop_sequence, effective_speed_mps, speed_eta_warm, hist_travel_time_est FROM primed",
    "features": with_(*TRIPS, PRIORS_SQL, ORDERED_SQL, STATIONARY_SQL, " codes AS (SELECT route_id, row_number() OVER (ORDER BY route_id) - 1 AS code FROM (SELECT DISTINCT route_id FROM training))", recursive=True)
    + """SELECT p.vehicle_id, p.trip_id, p.seq, code::INT AS route_code, p.route_id, stop_sequence, stops_ahead, p.hour, (isodow(service_date) - 1)::INT AS day_of_week, month(service_date)::INT AS month, CASE WHEN isodow(service_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN month(service_date) * 100 + day(service_date) IN (101, 107, 308, 501, 509, 628, 824, 1014, 1225) THEN 1 ELSE 0 END AS is_holiday, greatest(0.0::DOUBLE, stop_dist_m - dist_m) AS remaining_dist_m, progress_speed_mps, stops_remaining,
         stop_dist_m / 3900.0::DOUBLE AS trip_progress_frac, greatest(0.0::DOUBLE, stop_dist_m - dist_m) / stops_ahead AS dist_per_stop_m, speed_eta_warm, hist_speed_mps, hist_travel_time_est, stationary_sec, seconds_to_arrival
       FROM primed p JOIN still s ON s.vehicle_id = p.vehicle_id AND s.trip_id = p.trip_id AND s.seq = p.seq JOIN codes c ON c.route_id = p.route_id""",
    "sane_rows": with_(*TRIPS) + "SELECT route_id, count(*) AS n, max(seconds_to_arrival) AS longest FROM training WHERE seconds_to_arrival BETWEEN 0 AND 3600 AND route_id NOT IN ('3', '7') GROUP BY route_id",
    "sample_weights": with_(*TRIPS) + "SELECT hour, sum(CASE WHEN hour >= 18 OR hour <= 3 THEN 2.0::DOUBLE WHEN hour BETWEEN 14 AND 16 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM training GROUP BY hour",
    "uncertainty_by_horizon": with_(*TRIPS, PRIORS_SQL) + "SELECT stops_ahead, count(*) AS n, avg(abs(speed_eta_warm - seconds_to_arrival)) AS mae_sec FROM primed GROUP BY stops_ahead HAVING count(*) >= 200",
    "score_by_axis": _joined_sql
    + " UNION ALL ".join([_axis("overall", "''", ""), _axis("lead", "lead_bucket", "lead_bucket"), _axis("hour", "hour::VARCHAR", "hour"), _axis("route", "route_id", "route_id"), _axis("stops_ahead", "stops_ahead::VARCHAR", "stops_ahead"), _axis("day_stops_ahead", "day || ':' || stops_ahead::VARCHAR", "day, stops_ahead")]),
    "score_overall": _joined_sql + f"SELECT {METRICS_SQL} FROM kept",
    "score_drop_counts": _joined_sql
    + """SELECT count(*) AS n_joined, count_if(forward)::BIGINT AS n_forward, count_if(forward AND NOT plausible)::BIGINT AS n_implausible, count_if(forward AND plausible AND NOT on_schedule)::BIGINT AS n_off_schedule,
         count_if(forward AND plausible AND on_schedule)::BIGINT AS n_kept FROM joined""",
    "arriving_now": _joined_sql + "SELECT count(*) AS n, avg(CASE WHEN abs_error_sec <= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS calibrated_frac FROM kept WHERE lead_sec <= 60",
    "coverage_strict": _served + "SELECT count(*) AS n_actual, count(p.vehicle_id) AS n_covered, count(p.vehicle_id) / count(*) AS coverage_frac FROM actuals a LEFT JOIN (SELECT DISTINCT vehicle_id, trip_id, stop_id, stop_sequence FROM predictions) p USING (vehicle_id, trip_id, stop_id, stop_sequence)",
    "physical_stop_coverage": _served
    + """, c AS (SELECT EXISTS (SELECT 1 FROM predictions p WHERE p.vehicle_id = a.vehicle_id AND p.stop_id = a.stop_id AND abs(p.predicted_arrival - a.actual_arrival_ts) <= 3600) AS ok FROM actuals a)
       SELECT count(*) AS n_actual, count_if(ok)::BIGINT AS n_covered, count_if(ok) / count(*) AS coverage_frac FROM c""",
    "nearest_prediction": _served
    + """, nearest AS (SELECT a.vehicle_id, a.trip_id, a.stop_id, a.stop_sequence, actual_arrival_ts, predicted_arrival,
           row_number() OVER (PARTITION BY a.vehicle_id, a.trip_id, a.stop_id, a.stop_sequence ORDER BY abs(predicted_arrival - actual_arrival_ts) NULLS LAST, predicted_arrival) AS k
         FROM actuals a LEFT JOIN predictions p ON p.vehicle_id = a.vehicle_id AND p.stop_id = a.stop_id AND abs(p.predicted_arrival - actual_arrival_ts) <= 3600)
       SELECT vehicle_id, trip_id, stop_id, stop_sequence, actual_arrival_ts, predicted_arrival FROM nearest WHERE k = 1""",
    "coverage_gap_causes": with_(*TRIPS, PRIORS_SQL, SERVED_SQL, GAPS_SQL) + f"SELECT {GAP_COUNTS_SQL}",
    "coverage_gaps_by_route": with_(*TRIPS, PRIORS_SQL, SERVED_SQL, GAPS_SQL) + f"SELECT route_id, {GAP_COUNTS_SQL} GROUP BY route_id ORDER BY n_uncovered DESC, route_id LIMIT 20",
    "coverage_gaps_by_hour": with_(*TRIPS, PRIORS_SQL, SERVED_SQL, GAPS_SQL) + f"SELECT hour, {GAP_COUNTS_SQL} GROUP BY hour",
    "worst_routes": _joined_sql
    + f""", worst AS (SELECT route_id, count(*) AS route_n, avg(abs_error_sec) AS route_mae_sec FROM kept GROUP BY route_id HAVING count(*) >= 50 ORDER BY route_mae_sec DESC, route_id LIMIT 8)
       SELECT k.route_id, route_n, route_mae_sec, stops_ahead, {METRICS_SQL} FROM kept k JOIN worst w ON w.route_id = k.route_id GROUP BY k.route_id, route_n, route_mae_sec, stops_ahead""",
    "worst_predictions": _joined_sql + "SELECT route_id, vehicle_id, stop_id, stops_ahead, feed_ts, lead_sec, error_sec, abs_error_sec FROM kept ORDER BY abs_error_sec DESC, vehicle_id, stop_id, feed_ts LIMIT 5",
    "pooled_mae": _daily_sql
    + """, days AS (SELECT DISTINCT date FROM errors ORDER BY date DESC LIMIT 7),
       daily AS (SELECT date, stops_ahead, count(*) AS n, avg(abs(e)) AS m FROM errors JOIN days USING (date) GROUP BY date, stops_ahead),
       c AS (SELECT stops_ahead, sum(n)::BIGINT AS n, sum(m * n) / sum(n) AS m FROM daily GROUP BY stops_ahead HAVING sum(n) >= 200)
       SELECT stops_ahead, n, max(m) OVER (ORDER BY stops_ahead ROWS UNBOUNDED PRECEDING) AS mae_sec FROM c""",
    "pooled_bias": _daily_sql
    + """, days AS (SELECT DISTINCT date FROM errors WHERE date >= DATE '2024-01-20' ORDER BY date DESC LIMIT 7),
       daily AS (SELECT date, stops_ahead, count(*) AS n, avg(e) AS m FROM errors JOIN days USING (date) GROUP BY date, stops_ahead)
       SELECT stops_ahead, sum(n)::BIGINT AS n, sum(m * n) / sum(n) AS bias_sec FROM daily GROUP BY stops_ahead HAVING sum(n) >= 200""",
    "pooled_bias_by_day": _daily_sql
    + """, days AS (SELECT DISTINCT date FROM errors ORDER BY date DESC LIMIT 14),
       daily AS (SELECT date, day, stops_ahead, count(*) AS n, avg(e) AS m FROM errors JOIN days USING (date) GROUP BY date, day, stops_ahead)
       SELECT day, stops_ahead, sum(n)::BIGINT AS n, sum(m * n) / sum(n) AS bias_sec FROM daily GROUP BY day, stops_ahead HAVING sum(n) >= 200""",
    "bias_accumulate": _daily_sql
    + """, daily AS (SELECT date, stops_ahead, count(*) AS n, avg(e) AS m FROM errors GROUP BY date, stops_ahead),
       p AS (SELECT date < DATE '2024-01-16' AS old, stops_ahead, sum(m * n) / sum(n) AS b FROM daily GROUP BY 1, 2 HAVING sum(n) >= 200)
       SELECT r.stops_ahead, round_even(COALESCE(l.b, 0) + 0.5::DOUBLE * r.b, 0)::BIGINT AS bias_sec FROM p r LEFT JOIN p l ON l.old AND l.stops_ahead = r.stops_ahead WHERE NOT r.old""",
    "weekend_merge": _daily_sql
    + """, daily AS (SELECT date, day, stops_ahead, count(*) AS n, avg(e) AS m FROM errors GROUP BY date, day, stops_ahead),
       every AS (SELECT date, stops_ahead, count(*) AS n, avg(e) AS m FROM errors GROUP BY date, stops_ahead),
       flat AS (SELECT stops_ahead, round(sum(m * n) / sum(n))::BIGINT AS f FROM every GROUP BY stops_ahead HAVING sum(n) >= 200),
       live AS (SELECT day, stops_ahead, round(sum(m * n) / sum(n))::BIGINT AS l FROM daily WHERE date < DATE '2024-01-16' AND stops_ahead <= 6 GROUP BY day, stops_ahead HAVING sum(n) >= 20),
       residual AS (SELECT day, stops_ahead, sum(m * n) / sum(n) AS r FROM daily WHERE date >= DATE '2024-01-16' AND stops_ahead <= 3 GROUP BY day, stops_ahead HAVING sum(n) >= 20),
       keys AS (SELECT day, stops_ahead FROM (SELECT day FROM live UNION SELECT day FROM residual), (SELECT stops_ahead FROM flat) UNION SELECT day, stops_ahead FROM live UNION SELECT day, stops_ahead FROM residual)
       SELECT k.day, k.stops_ahead, COALESCE(round_even(COALESCE(l, 0) + 0.5::DOUBLE * r, 0)::BIGINT, l, f) AS bias_sec
       FROM keys k LEFT JOIN flat USING (stops_ahead) LEFT JOIN live v ON v.day = k.day AND v.stops_ahead = k.stops_ahead LEFT JOIN residual w ON w.day = k.day AND w.stops_ahead = k.stops_ahead""",
    "route_digest_delta": _daily_sql
    + """, daily AS (SELECT date, route_id, count(*) AS n, avg(abs(e)) AS m FROM errors GROUP BY date, route_id)
       SELECT d.route_id, d.date, d.n, d.m AS mae_sec, d.m - b.m AS delta_sec, d.n < 30 AS thin FROM daily d LEFT JOIN daily b ON b.route_id = d.route_id AND b.date = d.date - 1""",
}

#: Means and the like, whose last digits depend on the order of summation.
ROUNDED = {
    "sample_weights": ["weight"], "uncertainty_by_horizon": ["mae_sec"], "arriving_now": ["calibrated_frac"], "pooled_mae": ["mae_sec"], "pooled_bias": ["bias_sec"], "pooled_bias_by_day": ["bias_sec"], "route_digest_delta": ["mae_sec", "delta_sec"],
    **{q: ["bias_sec", "mae_sec", "median_ae_sec", "p90_ae_sec"] for q in ("score_by_axis", "score_overall")}, "worst_routes": ["route_mae_sec", "bias_sec", "mae_sec", "median_ae_sec", "p90_ae_sec"],
}
QUERIES, SQL = rounded_queries(QUERIES, ROUNDED), rounded_sql(SQL, ROUNDED)
