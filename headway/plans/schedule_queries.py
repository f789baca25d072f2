"""Queries for clocks, calendars, geometry, matching, the segment model, serving rules and quality, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import clock, geo, serving
from headway.operators import linktime as L
from headway.operators import matching as M
from headway.operators import quality as Q
from headway.operators import schedule as SC
from headway.operators import shapes as SH
from headway.operators import trajectory as T
from headway.plans import testbed as B
from headway.plans.rounding import rounded_queries, rounded_sql
from headway.plans.scoring_queries import PRIORS_SQL, _primed, _rows
from headway.plans.trajectory_queries import DWELL_SQL, TRIPS, with_
from headway.staging import written

ROUTES, POINTS = 25, 40


def _times(spark, sf_dir):
    """Strings of service times from the orders, hours up to 27, some of them broken."""
    o = B.read(spark, sf_dir, "orders")
    text = F.format_string("%02d:%02d:%02d", (F.col("o_orderkey") % 28).cast("int"), (F.col("o_custkey") % 60).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.substring(text, 1, 5)).when(F.col("o_orderkey") % 13 == 0, F.concat(text, F.lit("x"))).otherwise(text).alias("text"))


TIMES_SQL = """
times0 AS (SELECT o_orderkey, format('{:02d}:{:02d}:{:02d}', o_orderkey % 28, o_custkey % 60, o_orderkey % 60) AS full_text FROM orders),
times AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN substr(full_text, 1, 5) WHEN o_orderkey % 13 = 0 THEN full_text || 'x' ELSE full_text END AS text FROM times0)"""


def gtfs_time_parse(spark, sf_dir):
    return _times(spark, sf_dir).select("o_orderkey", clock.service_seconds(F.col("text")).alias("sec"))


def service_date_wrap(spark, sf_dir):
    t = _times(spark, sf_dir).withColumn("sec", clock.service_seconds(F.col("text"))).where("sec IS NOT NULL")
    now = (F.col("o_orderkey") * 97 % 86400).cast("int")
    return t.select("o_orderkey", clock.wrapped(F.col("sec") - now).alias("wrapped"), clock.until_departure(F.col("sec"), now, F.lit(0)).alias("until_departure"), clock.instance(F.col("sec"), now, F.lit("2024-03-01").cast("date")).alias("service_date"), clock.service_text(F.col("sec")).alias("text"))


def _calendar(spark):
    rows = spark.range(12).select(F.concat(F.lit("svc"), F.col("id").cast("string")).alias("service_id"), F.expr("date_add(DATE'2024-01-01', cast(id * 2 as int))").alias("start_date"), F.expr("date_add(DATE'2024-01-20', cast(id * 3 as int))").alias("end_date"), "id")
    return rows.select("service_id", "start_date", "end_date", *(((F.col("id") + i) % 3 > 0).cast("int").alias(d) for i, d in enumerate(SC.WEEKDAYS)))


def _exceptions(spark):
    return spark.range(60).select(F.concat(F.lit("svc"), (F.col("id") % 12).cast("string")).alias("service_id"), F.expr("date_add(DATE'2024-01-01', cast(id * 7 % 31 as int))").alias("day"), (F.col("id") % 2 + 1).cast("int").alias("exception_type"))


def active_services(spark, sf_dir):
    days = B.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return SC.active_services(_calendar(spark), _exceptions(spark), days)


def _stop_times(spark, sf_dir):
    """Each line number a stop of its order's trip, with a time of the service day."""
    li = B.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"))
    sec = 18_000 + (F.col("l_orderkey") * 37 % 60_000) + F.col("l_linenumber") * (60 + F.col("l_suppkey") % 30)
    sec = sec.cast("int")
    text = F.format_string("%02d:%02d:%02d", (sec / 3600).cast("int"), (sec % 3600 / 60).cast("int"), sec % 60)
    return li.select(F.col("l_orderkey").cast("string").alias("trip_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), text.alias("arrival_time"), F.lit(None).cast("string").alias("departure_time"), (F.col("l_linenumber") * 300.0).alias("dist_m"))


STOP_TIMES_SQL = """
stop_times AS (SELECT l_orderkey::VARCHAR AS trip_id, 's' || l_suppkey::VARCHAR AS stop_id, l_linenumber AS stop_sequence, 18000 + (l_orderkey * 37) % 60000 + l_linenumber * (60 + l_suppkey % 30) AS sec, l_linenumber * 300.0::DOUBLE AS dist_m FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
profile AS (SELECT trip_id, stop_id, stop_sequence, dist_m, max(since) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS UNBOUNDED PRECEDING)::INT AS cum_sec
            FROM (SELECT *, sec - first(sec) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS since FROM stop_times))"""


def sched_profile(spark, sf_dir):
    return SC.profiles(_stop_times(spark, sf_dir))


def trips_running(spark, sf_dir):
    trips = SC.running(SC.bounds(_stop_times(spark, sf_dir)), 43_200)
    return trips.select("trip_id", F.col("first_sec").cast("long").alias("first_sec"), F.col("last_sec").cast("long").alias("last_sec"), "running")


def sched_at_dist(spark, sf_dir):
    """The seconds at a distance, for each order's vehicle, and the distance at those seconds plus half a minute."""
    profile = SC.profiles(_stop_times(spark, sf_dir))
    v = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), (F.col("o_orderkey") * 13 % 2500).cast("double").alias("dist_m"))
    at = SC.seconds_at(v, profile).withColumn("elapsed_sec", F.col("sched_sec") + 30.0)
    return SC.distance_at(at, profile)


def holiday_flags(spark, sf_dir):
    from headway.operators.features import is_holiday

    return B.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).select("day", is_holiday(F.col("day")).alias("is_holiday"))


def _shapes(spark):
    i = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1)))
    p = spark.range(ROUTES).select("id", i.alias("i"))
    return SH.segments(p.select(F.col("id").cast("string").alias("shape_id"), F.col("i").alias("seq"), (F.col("i") * 1000.0).alias("x"), ((F.col("id") * 37 + F.col("i") * 53) % 11 * 100.0).alias("y")))


SHAPES_SQL = """
pts AS (SELECT r::VARCHAR AS shape_id, i AS seg, i * 1000.0::DOUBLE AS ax, ((r * 37 + i * 53) % 11) * 100.0::DOUBLE AS ay FROM range(25) a(r), range(40) b(i)),
seg0 AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS yb FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY seg)),
segs AS (SELECT *, sqrt((bx - ax) ** 2 + (yb - ay) ** 2) AS len_m, COALESCE(sum(sqrt((bx - ax) ** 2 + (yb - ay) ** 2)) OVER (PARTITION BY shape_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM seg0 WHERE bx IS NOT NULL),
points AS (SELECT user_id::VARCHAR AS vehicle_id, event_id AS seq, (user_id % 25)::VARCHAR AS shape_id, (event_id * 7919 % 39000)::DOUBLE AS x, (event_id * 104729 % 1100)::DOUBLE AS y, (event_id * 31 % 39000)::DOUBLE AS expected_m FROM events),
shares AS (SELECT p.*, s.seg, s.ax, s.ay, s.bx, s.yb, s.start_m, s.len_m, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2))) AS share FROM points p JOIN segs s ON s.shape_id = p.shape_id),
near_segs AS (SELECT *, sqrt((x - (ax + share * (bx - ax))) ** 2 + (y - (ay + share * (yb - ay))) ** 2) AS off_m, start_m + share * len_m AS along_m FROM shares)"""


def _points(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("vehicle_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 25).cast("string").alias("shape_id"), (F.col("event_id") * 7919 % 39000).cast("double").alias("x"), (F.col("event_id") * 104729 % 1100).cast("double").alias("y"), (F.col("event_id") * 31 % 39000).cast("double").alias("expected_m"))


def poly_match(spark, sf_dir):
    return SH.project(_points(spark, sf_dir), _shapes(spark), ["vehicle_id", "seq"])


def poly_project_near(spark, sf_dir):
    return SH.project_near(_points(spark, sf_dir), _shapes(spark), ["vehicle_id", "seq"], slack=400.0)


def shape_bbox(spark, sf_dir):
    b = SH.boxes(_shapes(spark))
    p = _points(spark, sf_dir).join(b, "shape_id")
    return p.select("vehicle_id", "seq", geo.box_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1"))).alias("lower_m"))


def utm_project(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    x, y = geo.utm(23.5 + F.col("event_id") % 1000 / 1000.0, 49.5 + F.col("event_id") % 777 / 777.0)
    return e.select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def bearing_diff(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    a, b = (F.col("event_id") * 37 % 360).cast("double"), (F.col("user_id") * 91 % 360).cast("double")
    return e.select("event_id", geo.bearing_diff(a, b).alias("diff"), F.round(geo.bearing(F.col("event_id") % 7 - 3.0, F.col("user_id") % 5 - 2.0), 6).alias("bearing"))


def _candidates(spark, sf_dir):
    """Each fix with the four trips of its route, on two shapes."""
    trips = spark.range(ROUTES * 4).select(F.col("id").cast("string").alias("trip_id"), (F.col("id") % 25).cast("string").alias("route_id"), ((F.col("id") % 25 + F.col("id") % 2) % 25).cast("string").alias("shape_id"))
    p = _points(spark, sf_dir).withColumnRenamed("shape_id", "route_id").withColumns({"bearing": F.pmod(F.col("seq") * 37, F.lit(360)).cast("double"), "t": F.col("seq").cast("double"), "reported_trip_id": (F.col("seq") % 100).cast("string")})
    segs = _shapes(spark)
    return M.scored(M.match_shapes(p, trips, segs), SH.lengths(segs))


def trip_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("vehicle_id", "seq", "trip_id", F.round("off_m", 3).alias("off_m"), F.when(F.col("score") < float("inf"), F.round("score", 6)).alias("score"))


def trip_match(spark, sf_dir):
    return M.best_trip(_candidates(spark, sf_dir), ["vehicle_id", "seq"]).select("vehicle_id", "seq", "trip_id", F.round("min_off_m", 3).alias("min_off_m"))


def trip_match_hysteresis(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    sure = M.trusted(rows).select("vehicle_id", "seq", "trip_id", F.lit(True).alias("trusted"))
    rows = rows.join(sure, ["vehicle_id", "seq", "trip_id"], "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return M.with_hysteresis(rows).select("vehicle_id", "seq", "trip_id", F.round("score", 6).alias("score"), F.round("off_m", 3).alias("off_m"), "high_confidence")


def stop_distances(spark, sf_dir):
    """Stops along a shape for each customer with orders; those of every third customer turn back half-way, so that the cursor counts."""
    c, k = F.col("o_custkey"), F.col("stop_sequence")
    shapes = B.read(spark, sf_dir, "orders").select("o_custkey").distinct()
    points = shapes.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    segs = SH.segments(points.select(c.cast("string").alias("shape_id"), "seq", (F.col("seq") * 1000.0).alias("x"), ((c * 37 + F.col("seq") * 53) % 11 * 100.0).alias("y")))
    stops = shapes.withColumn("stop_sequence", F.explode(F.sequence(F.lit(0), F.lit(19))))
    x = F.when((c % 3 == 0) & (k >= 10), (19 - k) * 1900.0).otherwise(k * 1900.0)
    stops = stops.select(c.cast("string").alias("shape_id"), c.cast("string").alias("trip_id"), "stop_sequence", F.concat_ws("-", c.cast("string"), k.cast("string")).alias("stop_id"), x.alias("x"), F.lit(300.0).alias("y"))
    return SH.stop_distances(stops, segs).select("shape_id", "stop_id", F.round("dist_m", 3).alias("dist_m"), F.round("naive_m", 3).alias("naive_m"), "is_ambiguous")


def link_observations(spark, sf_dir):
    return L.link_observations(_rows(spark, sf_dir))


def link_tables(spark, sf_dir):
    return L.link_tables(L.link_observations(_rows(spark, sf_dir)))


def segment_eta(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return L.predict_segments(rows, written(L.link_tables(L.link_observations(rows)), "link-tables")).select("vehicle_id", "trip_id", "seq", "stop_sequence", "segment_eta")


def segment_eta_calibrated(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    p = written(L.predict_segments(rows, written(L.link_tables(L.link_observations(rows)), "link-tables"), congestion=True), "segment-etas")
    c = L.calibrated(p, L.horizon_corrections(p))
    return c.groupBy("stops_ahead").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("calibrated_eta") - F.col("seconds_to_arrival"))).alias("mae_sec"))


def baseline_eta(spark, sf_dir):
    f = B.fixes(spark, sf_dir)
    start = f.groupBy("trip_id").agg(F.min("t").alias("t0"))
    s = B.stops(f).join(start, "trip_id").select("trip_id", "stop_sequence", "stop_dist_m", (F.col("t0") + F.col("stop_sequence") * 60.0).alias("scheduled"))
    out = SC.baseline_eta(f.select("vehicle_id", "trip_id", "seq", "dist_m", "t"), s)
    return out.groupBy("vehicle_id", "trip_id", "seq", "delay_sec").agg(F.count("*").alias("n_ahead"), F.max("estimated").alias("last_eta"))


def isotonic_fit(spark, sf_dir):
    """The fit of each fix's ETAs, after which they never fall with the stops ahead."""
    rows = _primed(spark, sf_dir)
    a = rows.groupBy("vehicle_id", "trip_id", "seq").agg(F.expr("transform(array_sort(collect_list(struct(stops_ahead, cast(round((speed_eta_warm * 7) % 500) as double) as v))), x -> x.v)").alias("v"))
    return a.select("vehicle_id", "trip_id", "seq", F.posexplode(serving.isotonic(F.col("v"))).alias("i", "fit")).withColumn("i", F.col("i").cast("long"))


def congestion_level(spark, sf_dir):
    rows = _primed(spark, sf_dir)
    return rows.groupBy(serving.congestion_level(F.col("progress_speed_mps"), F.col("hist_speed_mps")).alias("level")).agg(F.count("*").alias("n"))


def stop_status(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.groupBy("stops_ahead", serving.stop_status(F.col("stop_dist_m") - F.col("dist_m")).alias("status")).agg(F.count("*").alias("n"))


def horizon_fence(spark, sf_dir):
    f = B.fixes(spark, sf_dir)
    return Q.horizon_fence(f, B.stops(f))


def _feed(spark, sf_dir):
    """Events as fixes of a feed every ten compressed seconds, some of them hours old."""
    f = B.fixes(spark, sf_dir)
    return f.select("vehicle_id", "seq", (F.floor(F.col("t") / 10) * 10 + F.when(F.floor(F.col("t") / 10) % 3 == 0, 400).otherwise(0)).cast("long").alias("feed_ts"), F.floor(F.col("t") - F.when(F.col("seq") % 17 == 0, 7200).otherwise(0)).cast("long").alias("fix_ts"))


def staleness_anchor(spark, sf_dir):
    return Q.staleness(_feed(spark, sf_dir)).select("vehicle_id", "seq", "feed_ts", "reference_ts", "skew_sec", "is_stale")


def collapse_guard(spark, sf_dir):
    """Passes of each service date, of sizes that collapse now and then."""
    e = B.read(spark, sf_dir, "events")
    p = e.select(F.to_date("ts").alias("day"), F.col("event_id").alias("pass_no"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 60).otherwise(F.col("event_id") * 31 % 600).alias("n_entities"))
    return Q.collapse_guard(p, by="day")


def health_verdict(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    v = serving.health_verdict(F.when(F.col("event_id") % 50 > 0, F.col("event_id") % 240), F.col("user_id") % 3, F.hour("ts"), F.col("event_id") % 5, F.col("user_id") % 6)
    return e.select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def snapshot_day_stats(spark, sf_dir):
    return Q.day_statistics(B.fixes(spark, sf_dir))


def describe_percentiles(spark, sf_dir):
    f = B.fixes(spark, sf_dir)
    return Q.describe(T.dwell_events(f, B.stops(f)), "dwell_sec")


def silver_dedup(spark, sf_dir):
    f = B.fixes(spark, sf_dir).withColumn("feed_ts", (F.floor(F.col("t") / 60) * 60).cast("long"))
    return Q.dedup_fixes(f.select("vehicle_id", "feed_ts", "seq", "off_m"))


def silver_gate(spark, sf_dir):
    f = B.fixes(spark, sf_dir).withColumn("feed_ts", (F.floor(F.col("t") / 60) * 60).cast("long"))
    return Q.silver_gate(f)


QUERIES = {
    f.__name__: f
    for f in (
        gtfs_time_parse, service_date_wrap, active_services, sched_profile, trips_running, sched_at_dist, holiday_flags, poly_match, poly_project_near, shape_bbox, utm_project, bearing_diff, trip_score, trip_match, trip_match_hysteresis,
        stop_distances, link_observations, link_tables, segment_eta, segment_eta_calibrated, baseline_eta, isotonic_fit, congestion_level, stop_status, horizon_fence, staleness_anchor, collapse_guard, health_verdict, snapshot_day_stats, describe_percentiles, silver_dedup, silver_gate,
    )
}

LINKS_SQL = """
diffs AS (SELECT route_id, stop_id, hour, seconds_to_arrival - lag(seconds_to_arrival) OVER w AS link_sec, stop_dist_m - lag(stop_dist_m) OVER w AS link_m, stops_ahead - lag(stops_ahead) OVER w AS d
          FROM training WINDOW w AS (PARTITION BY vehicle_id, trip_id, seq ORDER BY stops_ahead)),
links AS (SELECT route_id, stop_id, hour, link_sec, link_m FROM diffs WHERE d = 1 AND link_sec > 0 AND link_sec < 1800),
tables AS (SELECT CASE grouping(route_id, stop_id, hour) WHEN 0 THEN 'rsh' WHEN 1 THEN 'rs' WHEN 5 THEN 's' WHEN 2 THEN 'rh' ELSE 'all' END AS level, route_id, stop_id, hour, count(*) AS n,
                  quantile_cont(link_sec, 0.5) AS link_sec, quantile_cont(link_m, 0.5) AS link_m, quantile_cont(link_m / link_sec, 0.5) AS link_mps
           FROM links GROUP BY GROUPING SETS ((route_id, stop_id, hour), (route_id, stop_id), (stop_id), (route_id, hour), ())),
looked AS (SELECT t.*, COALESCE(a.link_sec, b.link_sec, c.link_sec, d.link_sec, g.link_sec) AS link0, CASE WHEN b.link_m > 1 THEN b.link_m ELSE g.link_m END AS seg_m, COALESCE(d.link_mps, g.link_mps) AS usual
           FROM training t LEFT JOIN tables a ON a.level = 'rsh' AND a.route_id = t.route_id AND a.stop_id = t.stop_id AND a.hour = t.hour LEFT JOIN tables b ON b.level = 'rs' AND b.route_id = t.route_id AND b.stop_id = t.stop_id
           LEFT JOIN tables c ON c.level = 's' AND c.stop_id = t.stop_id LEFT JOIN tables d ON d.level = 'rh' AND d.route_id = t.route_id AND d.hour = t.hour LEFT JOIN tables g ON g.level = 'all')"""
ETA_SQL = """
etas AS (SELECT *, greatest(0, least(1, (first(stop_dist_m) OVER w - dist_m) / greatest(first(seg_m) OVER w, 1.0))) * first(link) OVER w + sum(link) OVER (w ROWS UNBOUNDED PRECEDING) - first(link) OVER w AS segment_eta
         FROM linked WINDOW w AS (PARTITION BY vehicle_id, trip_id, seq ORDER BY stops_ahead))"""
UTM_E2 = 2 * geo.FLATTENING - geo.FLATTENING**2
UTM_EP2 = UTM_E2 / (1 - UTM_E2)
UTM_SQL = f"""
g AS (SELECT event_id, radians(23.5::DOUBLE + event_id % 1000 / 1000.0::DOUBLE) AS lam, radians(49.5::DOUBLE + event_id % 777 / 777.0::DOUBLE) AS phi FROM events),
h AS (SELECT *, tan(phi) * tan(phi) AS t, {UTM_EP2!r}::DOUBLE * cos(phi) * cos(phi) AS c, cos(phi) * (lam - radians(27.0::DOUBLE)) AS a, 6378137.0::DOUBLE / sqrt(1 - {UTM_E2!r}::DOUBLE * sin(phi) * sin(phi)) AS n,
      6378137.0::DOUBLE * ({1 - UTM_E2 / 4 - 3 * UTM_E2**2 / 64 - 5 * UTM_E2**3 / 256!r}::DOUBLE * phi - {3 * UTM_E2 / 8 + 3 * UTM_E2**2 / 32 + 45 * UTM_E2**3 / 1024!r}::DOUBLE * sin(2 * phi)
        + {15 * UTM_E2**2 / 256 + 45 * UTM_E2**3 / 1024!r}::DOUBLE * sin(4 * phi) - {35 * UTM_E2**3 / 3072!r}::DOUBLE * sin(6 * phi)) AS m FROM g)
SELECT event_id, round(0.9996::DOUBLE * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {UTM_EP2!r}::DOUBLE) * a ** 5 / 120) + 500000, 3) AS x,
       round(0.9996::DOUBLE * (m + n * tan(phi) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {UTM_EP2!r}::DOUBLE) * a ** 6 / 720)), 3) AS y FROM h"""
SCORES_SQL = """
trips AS (SELECT id::VARCHAR AS trip_id, (id % 25)::VARCHAR AS route_id, ((id % 25 + id % 2) % 25)::VARCHAR AS shape_id FROM range(100) r(id)),
lens AS (SELECT shape_id, max(start_m + len_m) AS length_m FROM segs GROUP BY shape_id),
cand AS (SELECT p.vehicle_id, p.seq, p.x, p.y, p.expected_m, t.trip_id, t.shape_id, ((p.seq * 37) % 360)::DOUBLE AS bearing FROM points p JOIN trips t ON t.route_id = p.shape_id),
cshare AS (SELECT c.*, s.seg, s.ax, s.ay, s.bx, s.yb, s.start_m, s.len_m, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2))) AS share FROM cand c JOIN segs s ON s.shape_id = c.shape_id),
cnear AS (SELECT *, sqrt((x - (ax + share * (bx - ax))) ** 2 + (y - (ay + share * (yb - ay))) ** 2) AS off_m, start_m + share * len_m AS along_m, (degrees(atan2(bx - ax, yb - ay)) + 360) % 360 AS tangent FROM cshare
          QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq, trip_id ORDER BY off_m, seg) = 1),
scored AS (SELECT n.*, CASE WHEN off_m <= 100 THEN 0.4 * (off_m / 100.0) + 0.3 * (least((bearing - tangent + 360) % 360, 360 - (bearing - tangent + 360) % 360) / 180.0) + 0.3 * least(abs(along_m - expected_m) / greatest(length_m, 1.0), 1.0) END AS score
           FROM cnear n JOIN lens l ON l.shape_id = n.shape_id)"""
HYSTERESIS_SQL = """
cs AS (SELECT vehicle_id, seq, trip_id, off_m, COALESCE(score, 'inf'::DOUBLE) AS score, trip_id = (seq % 100)::VARCHAR AND off_m < 50 AS sure FROM scored),
picks AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, score, trip_id) = 1),
ways AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY seq) AS rn FROM picks),
run AS (SELECT vehicle_id, 0::BIGINT AS seq, 0::BIGINT AS rn, NULL::VARCHAR AS before, NULL::VARCHAR AS found, NULL::DOUBLE AS score, NULL::DOUBLE AS off_m FROM ways WHERE rn = 1
  UNION ALL
  SELECT vehicle_id, seq, rn, COALESCE(found, before), found, score, off_m
  FROM (SELECT w.vehicle_id, w.seq, w.rn, r.before, CASE WHEN stays THEN b.trip_id WHEN w.score < 'inf'::DOUBLE THEN w.trip_id END AS found, CASE WHEN stays THEN b.score ELSE w.score END AS score, CASE WHEN stays THEN b.off_m ELSE w.off_m END AS off_m
        FROM run r JOIN ways w ON w.vehicle_id = r.vehicle_id AND w.rn = r.rn + 1 LEFT JOIN cs b ON b.seq = w.seq AND b.trip_id = r.before,
             LATERAL (SELECT COALESCE(NOT w.sure AND b.off_m <= 150 AND (w.score = 'inf'::DOUBLE OR b.off_m <= w.off_m), false) AS stays) q))"""
CURSOR_SQL = """
of AS (SELECT DISTINCT o_custkey AS c FROM orders),
pts AS (SELECT c, i AS seg, i * 1000.0::DOUBLE AS ax, ((c * 37 + i * 53) % 11) * 100.0::DOUBLE AS ay FROM of, range(40) r(i)),
seg0 AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS yb FROM pts WINDOW w AS (PARTITION BY c ORDER BY seg)),
segs AS (SELECT *, sqrt((bx - ax) ** 2 + (yb - ay) ** 2) AS len_m, COALESCE(sum(sqrt((bx - ax) ** 2 + (yb - ay) ** 2)) OVER (PARTITION BY c ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM seg0 WHERE bx IS NOT NULL),
met AS (SELECT g.*, k, x, ((x - ax) * (bx - ax) + (300 - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2) AS share FROM segs g, (SELECT k, t, CASE WHEN t AND k >= 10 THEN (19 - k) * 1900.0::DOUBLE ELSE k * 1900.0::DOUBLE END AS x FROM range(20) r(k), (VALUES (true), (false)) v(t)) s WHERE t = (c % 3 = 0)),
free AS (SELECT c, k, start_m + greatest(0, least(1, share)) * len_m AS naive_m FROM met QUALIFY row_number() OVER (PARTITION BY c, k ORDER BY sqrt((x - (ax + greatest(0, least(1, share)) * (bx - ax))) ** 2 + (300 - (ay + greatest(0, least(1, share)) * (yb - ay))) ** 2), seg) = 1),
run AS (SELECT c, -1::BIGINT AS k, 0.0::DOUBLE AS dist_m, 0.0::DOUBLE AS cur FROM of
  UNION ALL
  SELECT c, k, b.at, greatest(cur, b.at) FROM (
    SELECT c, k, cur, min(struct_pack(off := sqrt((x - (ax + sh * (bx - ax))) ** 2 + (300 - (ay + sh * (yb - ay))) ** 2), seg := seg, at := start_m + sh * len_m)) AS b
    FROM (SELECT m.*, r.cur, greatest(greatest(0, least(1, (cur - start_m) / len_m)), least(1, share)) AS sh FROM run r JOIN met m ON m.c = r.c AND m.k = r.k + 1 WHERE start_m + len_m >= cur) GROUP BY c, k, cur))"""
_trained = with_(*TRIPS, LINKS_SQL)

SQL = {
    "gtfs_time_parse": with_(TIMES_SQL) + "SELECT o_orderkey, CASE WHEN regexp_full_match(text, '[0-9]+:[0-9]+:[0-9]+') THEN split_part(text, ':', 1)::INT * 3600 + split_part(text, ':', 2)::INT * 60 + split_part(text, ':', 3)::INT END AS sec FROM times",
    "service_date_wrap": with_(TIMES_SQL)
    + """, p AS (SELECT o_orderkey, text, split_part(text, ':', 1)::INT * 3600 + split_part(text, ':', 2)::INT * 60 + split_part(text, ':', 3)::INT AS sec, (o_orderkey * 97 % 86400)::INT AS now FROM times WHERE regexp_full_match(text, '[0-9]+:[0-9]+:[0-9]+')),
       q AS (SELECT *, (sec - now + 43200 + 86400) % 86400 - 43200 AS wrapped FROM p)
       SELECT o_orderkey, wrapped::INT AS wrapped, CASE WHEN wrapped BETWEEN -120 AND 1800 THEN greatest(wrapped, 0) END::INT AS until_departure, CASE WHEN sec - now > 43200 THEN DATE '2024-02-29' ELSE DATE '2024-03-01' END AS service_date, text FROM q""",
    "active_services": """WITH days AS (SELECT DISTINCT ts::DATE AS day FROM events),
       cal AS (SELECT 'svc' || id::VARCHAR AS service_id, DATE '2024-01-01' + (id * 2)::INT AS s, DATE '2024-01-20' + (id * 3)::INT AS e, id FROM range(12) r(id)),
       exc AS (SELECT 'svc' || (id % 12)::VARCHAR AS service_id, DATE '2024-01-01' + (id * 7 % 31)::INT AS day, id % 2 + 1 AS kind FROM range(60) r(id)),
       act AS (SELECT day, service_id FROM days JOIN cal ON day BETWEEN s AND e WHERE (id + isodow(day) - 1) % 3 > 0 UNION SELECT day, service_id FROM exc JOIN days USING (day) WHERE kind = 1)
       SELECT * FROM act EXCEPT SELECT day, service_id FROM exc WHERE kind = 2""",
    "sched_profile": with_(STOP_TIMES_SQL) + "SELECT * FROM profile",
    "trips_running": with_(STOP_TIMES_SQL)
    + """, b AS (SELECT trip_id, arg_min(sec, stop_sequence)::BIGINT AS first_sec, arg_max(sec, stop_sequence)::BIGINT AS last_sec FROM stop_times GROUP BY trip_id)
       SELECT *, 43200 BETWEEN first_sec - 600 AND last_sec + 1800 AS running FROM b""",
    "sched_at_dist": with_(STOP_TIMES_SQL)
    + """, v AS (SELECT o_orderkey::VARCHAR AS trip_id, (o_orderkey * 13 % 2500)::DOUBLE AS dist_m FROM orders),
       p AS (SELECT trip_id, list(struct_pack(x := dist_m, y := cum_sec::DOUBLE) ORDER BY dist_m, cum_sec) AS d, list(struct_pack(x := cum_sec::DOUBLE, y := dist_m) ORDER BY cum_sec, dist_m) AS s FROM profile GROUP BY trip_id HAVING count(*) >= 2),
       k AS (SELECT v.*, d, s, len(list_filter(d, lambda q: q.x <= dist_m)) AS k FROM v LEFT JOIN p ON p.trip_id = v.trip_id),
       a AS (SELECT trip_id, dist_m, s, CASE WHEN d IS NULL THEN NULL WHEN k = 0 THEN d[1].y WHEN k = len(d) THEN d[k].y ELSE d[k].y + (dist_m - d[k].x) / (d[k + 1].x - d[k].x) * (d[k + 1].y - d[k].y) END AS sched_sec FROM k),
       b AS (SELECT *, sched_sec + 30.0 AS elapsed_sec, len(list_filter(s, lambda q: q.x <= sched_sec + 30.0)) AS k FROM a)
       SELECT trip_id, dist_m, sched_sec, elapsed_sec, CASE WHEN s IS NULL THEN NULL WHEN k = 0 THEN s[1].y WHEN k = len(s) THEN s[k].y ELSE s[k].y + (elapsed_sec - s[k].x) / (s[k + 1].x - s[k].x) * (s[k + 1].y - s[k].y) END AS expected_m FROM b""",
    "holiday_flags": "SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) IN (101, 107, 308, 501, 509, 628, 824, 1014, 1225) THEN 1 ELSE 0 END AS is_holiday FROM orders",
    "poly_match": with_(SHAPES_SQL) + "SELECT vehicle_id, seq, shape_id, off_m, along_m, (degrees(atan2(bx - ax, yb - ay)) + 360) % 360 AS tangent FROM near_segs QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY off_m, seg) = 1",
    "poly_project_near": with_(SHAPES_SQL)
    + """, m AS (SELECT *, min(off_m) OVER (PARTITION BY vehicle_id, seq) AS least FROM near_segs)
       SELECT vehicle_id, seq, shape_id, off_m, along_m FROM m WHERE off_m <= least + 400 QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY abs(along_m - expected_m), seg) = 1""",
    "shape_bbox": with_(SHAPES_SQL)
    + """, b AS (SELECT shape_id, min(least(ax, bx)) AS x0, min(least(ay, yb)) AS y0, max(greatest(ax, bx)) AS x1, max(greatest(ay, yb)) AS y1 FROM segs GROUP BY shape_id)
       SELECT vehicle_id, seq, sqrt(greatest(x0 - x, x - x1, 0) ** 2 + greatest(y0 - y, y - y1, 0) ** 2) AS lower_m FROM points p JOIN b ON b.shape_id = p.shape_id""",
    "utm_project": "WITH " + UTM_SQL,
    "bearing_diff": """WITH d AS (SELECT event_id, user_id, ((event_id * 37 % 360)::DOUBLE - (user_id * 91 % 360)::DOUBLE + 360) % 360 AS d FROM events)
       SELECT event_id, least(d, 360 - d) AS diff, round((degrees(atan2(event_id % 7 - 3.0::DOUBLE, user_id % 5 - 2.0::DOUBLE)) + 360) % 360, 6) AS bearing FROM d""",
    "trip_score": with_(SHAPES_SQL, SCORES_SQL) + "SELECT vehicle_id, seq, trip_id, round(off_m, 3) AS off_m, round(score, 6) AS score FROM scored",
    "trip_match_hysteresis": with_(SHAPES_SQL, SCORES_SQL, HYSTERESIS_SQL, recursive=True) + "SELECT vehicle_id, seq, found AS trip_id, round(score, 6) AS score, round(off_m, 3) AS off_m, off_m < 50 AS high_confidence FROM run WHERE rn > 0",
    "stop_distances": with_(CURSOR_SQL, recursive=True)
    + """SELECT c::VARCHAR AS shape_id, c::VARCHAR || '-' || k::VARCHAR AS stop_id, round(dist_m, 3) AS dist_m, round(naive_m, 3) AS naive_m, bool_or(abs(dist_m - naive_m) > 50) OVER (PARTITION BY c) AS is_ambiguous FROM run JOIN free USING (c, k)""",
    "trip_match": with_(SHAPES_SQL, SCORES_SQL)
    + """, r AS (SELECT *, min(off_m) OVER (PARTITION BY vehicle_id, seq) AS m FROM scored QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY score NULLS LAST, trip_id) = 1)
       SELECT vehicle_id, seq, CASE WHEN score IS NOT NULL THEN trip_id END AS trip_id, round(m, 3) AS min_off_m FROM r""",
    "link_observations": _trained + "SELECT * FROM links",
    "link_tables": _trained + "SELECT * FROM tables",
    "segment_eta": with_(*TRIPS, LINKS_SQL, " linked AS (SELECT *, link0 AS link FROM looked)", ETA_SQL) + "SELECT vehicle_id, trip_id, seq, stop_sequence, segment_eta FROM etas",
    "segment_eta_calibrated": with_(*TRIPS, LINKS_SQL, " linked AS (SELECT *, link0 * greatest(0.7, least(2.0, CASE WHEN progress_speed_mps > 0.3 THEN usual / progress_speed_mps ELSE 1.0 END)) AS link FROM looked)", ETA_SQL)
    + """, c AS (SELECT stops_ahead, quantile_cont(segment_eta - seconds_to_arrival, 0.5) AS m FROM etas GROUP BY stops_ahead)
       SELECT e.stops_ahead, count(*) AS n, avg(abs(greatest(0, segment_eta - m) - seconds_to_arrival)) AS mae_sec FROM etas e JOIN c ON c.stops_ahead = e.stops_ahead GROUP BY e.stops_ahead""",
    "baseline_eta": with_(B.FIXES_SQL, B.STOPS_SQL, " starts AS (SELECT trip_id, min(t) AS t0 FROM fixes GROUP BY trip_id)")
    + """, d AS (SELECT f.vehicle_id, f.trip_id, f.seq, f.t, f.dist_m, t0, COALESCE(f.t - (SELECT max(t0 + k * 60.0::DOUBLE) FROM range(0, 40) r(k) WHERE k * 100.0 <= f.dist_m), 0) AS delay_sec FROM fixes f JOIN starts s ON s.trip_id = f.trip_id)
       SELECT vehicle_id, trip_id, seq, delay_sec, count(*) AS n_ahead, max(t0 + k * 60.0::DOUBLE + delay_sec) AS last_eta FROM d, range(0, 40) r(k) WHERE k * 100.0 > dist_m GROUP BY vehicle_id, trip_id, seq, delay_sec""",
    "isotonic_fit": with_(*TRIPS, PRIORS_SQL, " v AS (SELECT vehicle_id, trip_id, seq, stops_ahead AS i, round((speed_eta_warm * 7) % 500) AS v FROM primed)")
    + """, m AS (SELECT i.vehicle_id, i.trip_id, i.seq, i.i AS a, j.i AS b, (SELECT avg(v) FROM v k WHERE k.vehicle_id = i.vehicle_id AND k.trip_id = i.trip_id AND k.seq = i.seq AND k.i BETWEEN i.i AND j.i) AS m
                 FROM v i JOIN v j ON j.vehicle_id = i.vehicle_id AND j.trip_id = i.trip_id AND j.seq = i.seq AND j.i >= i.i),
       l AS (SELECT v.vehicle_id, v.trip_id, v.seq, v.i, a, min(m) AS m FROM v JOIN m ON m.vehicle_id = v.vehicle_id AND m.trip_id = v.trip_id AND m.seq = v.seq AND a <= v.i AND b >= v.i GROUP BY ALL)
       SELECT vehicle_id, trip_id, seq, i::BIGINT - 1 AS i, max(m) AS fit FROM l GROUP BY ALL""",
    "congestion_level": with_(*TRIPS, PRIORS_SQL)
    + """SELECT CASE WHEN progress_speed_mps > 0 AND hist_speed_mps > 0 THEN CASE WHEN progress_speed_mps / hist_speed_mps >= 0.7 THEN 'RUNNING_SMOOTHLY' WHEN progress_speed_mps / hist_speed_mps >= 0.4 THEN 'STOP_AND_GO'
         WHEN progress_speed_mps / hist_speed_mps >= 0.2 THEN 'CONGESTION' ELSE 'SEVERE_CONGESTION' END END AS level, count(*) AS n FROM primed GROUP BY 1""",
    "stop_status": with_(*TRIPS) + "SELECT stops_ahead, CASE WHEN stop_dist_m - dist_m <= 25 THEN 'STOPPED_AT' WHEN stop_dist_m - dist_m <= 150 THEN 'INCOMING_AT' ELSE 'IN_TRANSIT_TO' END AS status, count(*) AS n FROM training GROUP BY 1, 2",
    "horizon_fence": with_(B.FIXES_SQL, B.STOPS_SQL) + "SELECT vehicle_id, f.trip_id, seq, stop_id, stop_sequence FROM fixes f JOIN stops s ON s.trip_id = f.trip_id AND stop_dist_m > dist_m QUALIFY row_number() OVER (PARTITION BY vehicle_id, f.trip_id, seq ORDER BY stop_dist_m) = 11",
    "staleness_anchor": with_(B.FIXES_SQL)
    + """, f AS (SELECT vehicle_id, seq, (floor(t / 10) * 10 + CASE WHEN floor(t / 10) % 3 = 0 THEN 400 ELSE 0 END)::BIGINT AS feed_ts, floor(t - CASE WHEN seq % 17 = 0 THEN 7200 ELSE 0 END)::BIGINT AS fix_ts FROM fixes),
       n AS (SELECT *, max(CASE WHEN fix_ts > 0 THEN fix_ts END) OVER (PARTITION BY feed_ts) AS newest FROM f),
       s AS (SELECT *, greatest(COALESCE(feed_ts - newest, 0), 0) AS skew_sec, CASE WHEN feed_ts - newest > 180 AND feed_ts - newest <= 1800 THEN newest ELSE feed_ts END AS reference_ts FROM n)
       SELECT vehicle_id, seq, feed_ts, reference_ts, skew_sec, reference_ts - fix_ts > 180 AS is_stale FROM s""",
    "collapse_guard": """WITH RECURSIVE p AS (SELECT ts::DATE AS day, event_id AS pass_no, CASE WHEN event_id % 7 = 0 THEN event_id % 60 ELSE event_id * 31 % 600 END AS n, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS rn FROM events),
       g AS (SELECT day, pass_no, n, rn, n AS prev, true AS published FROM p WHERE rn = 1
             UNION ALL SELECT p.day, p.pass_no, p.n, p.rn, CASE WHEN g.prev < 20 OR p.n >= g.prev * 0.3::DOUBLE THEN p.n ELSE g.prev END, g.prev < 20 OR p.n >= g.prev * 0.3::DOUBLE FROM g JOIN p ON p.day = g.day AND p.rn = g.rn + 1)
       SELECT day, pass_no, n AS n_entities, published FROM g""",
    "health_verdict": """WITH e AS (SELECT CASE WHEN event_id % 50 > 0 THEN event_id % 240 END AS age, user_id % 3 AS arrivals, hour(ts) AS h, event_id % 5 AS vin, user_id % 6 AS vst FROM events)
       SELECT CASE WHEN age IS NULL THEN 'none' WHEN age > 180 THEN 'stale' WHEN h BETWEEN 5 AND 17 AND arrivals = 0 AND vin > 0 AND vst >= vin THEN 'degraded_upstream' WHEN h BETWEEN 5 AND 17 AND arrivals = 0 THEN 'degraded'
         WHEN age > 60 THEN 'aging' ELSE 'ok' END AS verdict, count(*) AS n FROM e GROUP BY 1""",
    "snapshot_day_stats": with_(B.FIXES_SQL)
    + "SELECT service_date, count(*) AS n, count(DISTINCT vehicle_id) AS n_vehicles, count(DISTINCT route_id) AS n_routes, count(DISTINCT trip_id) AS n_trips, count_if(bearing IS NULL)::BIGINT AS null_bearings, min(t) AS first_t, max(t) AS last_t, count(*) < 1000 AS is_low FROM fixes GROUP BY service_date",
    "describe_percentiles": with_(B.FIXES_SQL, DWELL_SQL)
    + """SELECT count(*) AS n, avg(dwell_sec) AS mean, stddev_samp(dwell_sec) AS std, min(dwell_sec) AS min, quantile_cont(dwell_sec, 0.25) AS p25, quantile_cont(dwell_sec, 0.5) AS p50, quantile_cont(dwell_sec, 0.75) AS p75,
         quantile_cont(dwell_sec, 0.9) AS p90, quantile_cont(dwell_sec, 0.95) AS p95, max(dwell_sec) AS max FROM dwells""",
    "silver_dedup": with_(B.FIXES_SQL) + "SELECT vehicle_id, (floor(t / 60) * 60)::BIGINT AS feed_ts, min(seq) AS seq, arg_min(off_m, seq) AS off_m FROM fixes GROUP BY 1, 2",
    "silver_gate": with_(B.FIXES_SQL)
    + """, e AS (SELECT service_date, (floor(t / 60) * 60)::BIGINT AS feed_ts, count(DISTINCT vehicle_id) AS v, count(*) AS r FROM fixes GROUP BY 1, 2),
       d AS (SELECT service_date, sum(r)::BIGINT AS n, count(*) AS n_snapshots, quantile_cont(v, 0.5)::DOUBLE AS median_vehicles FROM e GROUP BY 1)
       SELECT *, n >= 0.9::DOUBLE * n_snapshots * median_vehicles AS passes FROM d""",
}

ROUNDED = {
    "poly_match": ["off_m", "along_m", "tangent"], "poly_project_near": ["off_m", "along_m"], "shape_bbox": ["lower_m"], "segment_eta": ["segment_eta"], "segment_eta_calibrated": ["mae_sec"], "isotonic_fit": ["fit"], "describe_percentiles": ["mean", "std"], "sched_at_dist": ["sched_sec", "elapsed_sec", "expected_m"],
    "baseline_eta": ["delay_sec", "last_eta"], "link_tables": ["link_sec", "link_m", "link_mps"],
}
QUERIES, SQL = rounded_queries(QUERIES, ROUNDED), rounded_sql(SQL, ROUNDED)
