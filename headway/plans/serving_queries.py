"""Queries for served predictions, local clocks, versions of schedules, lookups and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import clock, serving
from headway.operators import features as FE
from headway.operators import linktime as L
from headway.operators import quality as Q
from headway.operators import schedule as SC
from headway.operators import serving as SV
from headway.operators import shapes as SH
from headway.operators import trajectory as T
from headway.plans import schedule_queries as S
from headway.plans import testbed as B
from headway.plans.rounding import rounded_queries, rounded_sql
from headway.plans.scoring_queries import _rows
from headway.plans.trajectory_queries import STATUS_SQL, TRIPS, with_
from headway.sources import snapshots

ZONE = "Europe/Kyiv"


def _vehicles(spark, sf_dir):
    """Fixes with what the live feed knows of them: kind of vehicle, the timetable's departure and the local clock."""
    f = B.fixes(spark, sf_dir)
    now = F.col("seq") * 97 % 86400
    return f.withColumns({"route_type": F.element_at(F.array(F.lit(0), F.lit(3), F.lit(11)), (F.col("seq") % 3 + 1).cast("int")), "now_sec": now, "departure_sec": now + F.col("seq") * 31 % 2400 - 300, "first_stop_m": F.lit(0.0)})


def _timed_stops(f):
    return B.stops(f).withColumn("cum_sec", (F.col("stop_sequence") * 60 + F.col("stop_sequence") * F.col("stop_sequence") % 7).cast("double"))


VEHICLES_SQL = """
vehicles AS (SELECT *, CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 11 END AS route_type, seq * 97 % 86400 AS now_sec, seq * 97 % 86400 + seq * 31 % 2400 - 300 AS departure_sec FROM fixes),
timed AS (SELECT *, (stop_sequence * 60 + stop_sequence * stop_sequence % 7)::DOUBLE AS cum_sec FROM stops),
ahead AS (SELECT * FROM (SELECT v.*, s.stop_id, s.stop_sequence, s.stop_dist_m, s.cum_sec, row_number() OVER (PARTITION BY v.seq ORDER BY s.stop_sequence) AS stops_ahead, 39 - s.stop_sequence AS stops_remaining
          FROM vehicles v JOIN timed s ON s.trip_id = v.trip_id AND s.stop_dist_m > v.dist_m) WHERE stops_ahead <= 10),
leaves AS (SELECT *, CASE WHEN route_type IN (0, 11) AND ((departure_sec - now_sec + 43200) % 86400 + 86400) % 86400 - 43200 BETWEEN -120 AND 1800 THEN greatest(((departure_sec - now_sec + 43200) % 86400 + 86400) % 86400 - 43200, 0) END AS until_departure FROM ahead)"""
SERVED = (B.FIXES_SQL, B.STOPS_SQL, VEHICLES_SQL)


def serving_features(spark, sf_dir):
    f = _vehicles(spark, sf_dir)
    lengths = f.select("trip_id").distinct().withColumn("length_m", F.lit(3900.0))
    names = ["vehicle_id", "trip_id", "seq", "stop_id", "stop_sequence", "stops_ahead", "stops_remaining", "hour", "day_of_week", "is_weekend", "month", "is_holiday", "remaining_dist_m", "trip_progress_frac", "dist_per_stop_m", "sched_remaining_sec"]
    return SV.serving_features(f, _timed_stops(f), lengths).select(*names)


def scheduled_remaining(spark, sf_dir):
    """The schedule's seconds ahead in training rows, by the timetable of the served features."""
    rows = _rows(spark, sf_dir)
    profile = _timed_stops(B.fixes(spark, sf_dir)).select("trip_id", F.col("stop_dist_m").alias("dist_m"), "cum_sec")
    return FE.scheduled_remaining(rows, profile).select("vehicle_id", "trip_id", "seq", "stop_sequence", "sched_remaining_sec")


def terminus_predictions(spark, sf_dir):
    f = _vehicles(spark, sf_dir)
    f = f.withColumn("until_departure", clock.until_departure(F.col("departure_sec"), F.col("now_sec"), F.col("route_type")))
    return SV.terminus_predictions(SV.upcoming(f, _timed_stops(f))).select("vehicle_id", "trip_id", "seq", "stop_id", "stop_sequence", "stops_ahead", "seconds")


def trip_delay(spark, sf_dir):
    f = _vehicles(spark, sf_dir)
    p = SV.upcoming(f, _timed_stops(f)).withColumns({"seconds": (F.col("stop_dist_m") - F.col("dist_m")) / 5.0, "scheduled": F.col("t") - F.col("departure_sec") % 700 + F.col("cum_sec")})
    return SV.trip_delay(p, ["vehicle_id", "trip_id", "seq"])


def dwell_lookup(spark, sf_dir):
    table = spark.createDataFrame([("0", 32.0), ("3", 27.0), ("_global", 28.5)], "route_type string, dwell_sec double")
    rows = B.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 13).cast("int").alias("route_type"))
    return SV.with_dwell(rows, table)


def bias_lookup(spark, sf_dir):
    tables = spark.createDataFrame([("weekend", 1, 10), ("weekend", 2, 20), ("flat", 2, 5), ("flat", 5, 15)], "kind string, stops_ahead int, bias_sec int")
    rows = B.read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("service_date"), (F.col("o_custkey") % 12).cast("int").alias("stops_ahead"))
    # the flat table has no value at 3 and 4: that of its longest horizon holds there
    return SV.with_bias(rows, tables)


def serving_rules(spark, sf_dir):
    f = _vehicles(spark, sf_dir).withColumn("until_departure", clock.until_departure(F.col("departure_sec"), F.col("now_sec"), F.col("route_type")))
    table = F.create_map(F.lit(1), F.lit(20), F.lit(2), F.lit(35), F.lit(3), F.lit(60))
    speed = (F.col("seq") % 3).cast("double")
    source = serving.prediction_source(speed, F.col("dist_m"), F.col("off_m"), F.col("first_stop_m"), F.col("until_departure"))
    arrivals = serving.arrival_times(F.floor("t"), F.array(F.col("off_m") - 200, F.col("off_m") / 2, F.col("off_m") + 60))
    return f.select(
        "vehicle_id", "seq", serving.at_first_stop(F.col("dist_m"), F.col("off_m"), F.col("first_stop_m")).alias("at_first_stop"), source.alias("source"),
        serving.band_seconds(source, serving.horizon_value(table, (F.col("seq") % 6).cast("int"))).alias("band_sec"), F.array_join(arrivals.cast("array<string>"), ",").alias("arrivals"),
        serving.usable_fix(F.col("seq") % 5, F.col("seq") % 7, F.when(F.col("seq") % 11 > 0, F.col("route_id")).otherwise("")).alias("usable"),
    )


def local_clock(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    at = F.col("at") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    day = F.to_date("at")
    return o.select("o_orderkey", clock.local_seconds_of_day(at, ZONE).alias("local_sec"), F.date_format(clock.service_instant(day, F.col("o_orderkey") % 75_000 + 14_400, ZONE), "yyyy-MM-dd HH:mm:ss").alias("instant"), clock.day_after(F.when(F.col("o_orderkey") % 7 > 0, day.cast("string")).otherwise("2024-13-01")).alias("next_day"))


def trip_instances(spark, sf_dir):
    times = S._stop_times(spark, sf_dir).withColumn("sec", clock.service_seconds(F.col("arrival_time")))
    trips = times.select("trip_id").distinct().withColumns({"now_sec": F.col("trip_id").cast("long") * 97 % 86400, "today": F.lit("2024-03-31").cast("date")})
    return SC.instances(times, trips, ZONE).withColumn("scheduled", F.date_format("scheduled", "yyyy-MM-dd HH:mm:ss"))


def schedule_versions(spark, sf_dir):
    days = B.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    versions = days.where(F.dayofmonth("day") == 5).select("day", F.date_format("day", "yyyyMMdd").alias("version"))
    return SC.latest_version(versions, days)


def active_trips(spark, sf_dir):
    stops = S._stop_times(spark, sf_dir)
    trips = stops.select("trip_id").distinct().select("trip_id", (F.col("trip_id").cast("long") % 25).cast("string").alias("route_id"), F.concat(F.lit("svc"), (F.col("trip_id").cast("long") % 12).cast("string")).alias("service_id"))
    return SC.active_trips(S.active_services(spark, sf_dir).where("day = DATE'2024-01-09'"), trips, SC.bounds(stops), 43_200)


def vehicle_kinds(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 3 == 0, "Тр").otherwise("А"), key.cast("string"))
    return SC.vehicle_kind(B.read(spark, sf_dir, "orders").select(key.cast("string").alias("route_id"), name.alias("route_short_name"), F.when(key % 5 == 0, "bus").otherwise((key % 4).cast("string")).alias("route_type")))


def trip_stop_times(spark, sf_dir):
    return SC.stop_times_of(S._stop_times(spark, sf_dir), ["1", "2", "3", "33"]).select("trip_id", "stop_id", "stop_sequence", "arrival_time")


def missing_days(spark, sf_dir):
    days = B.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return snapshots.missing_days(days, days.where(F.dayofmonth("date") % 3 == 0))


def older_columns(spark, sf_dir):
    """Rows of files written before and after a column was added."""
    e = B.read(spark, sf_dir, "events").select("event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("stationary_sec", F.col("event_id") / 2.0)
    fill = lambda d: snapshots.with_default(d, "stationary_sec", 0.0, "double")
    return fill(old).unionByName(fill(new))


def feed_repeats(spark, sf_dir):
    feeds = B.read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("source"), F.col("o_orderkey").alias("polled_at"), F.floor(F.col("o_orderkey") / 20).alias("feed_ts"))
    return Q.skip_repeated_feeds(feeds)


def stale_days(spark, sf_dir):
    rows = B.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("service_date"), F.lit(10_000).cast("long").alias("feed_ts"), (10_000 - F.col("o_orderkey") * 7 % 250).alias("fix_ts"))
    return Q.stale_days(rows)


def blended_arms(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    keys = ["l_orderkey", "l_linenumber"]
    return L.blended(rows.select(*keys, (F.col("q") * 150 - 600).alias("predicted")), rows.where("l_linenumber <> 2").select(*keys, F.when(F.col("p") % 5 > 0, F.col("p") % 3000 * 1.0).alias("predicted")), keys)


def snapshot_sample(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return FE.snapshot_sample(rows, 0.25, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def time_split_counts(spark, sf_dir):
    f = B.fixes(spark, sf_dir).withColumn("route_id", F.when(F.dayofmonth("service_date") >= 25, F.concat("route_id", F.lit("n"))).otherwise(F.col("route_id")))
    return FE.time_split(f, keys=("vehicle_id", "trip_id", "seq")).groupBy("service_date", "is_train").agg(F.count("*").alias("n"))


def offroute_by_trip(spark, sf_dir):
    f = B.fixes(spark, sf_dir).withColumn("bearing_diff", F.abs(F.col("bearing") - 180))
    return T.off_route_status(f, keys=("vehicle_id", "trip_id")).select("trip_id", "seq", "t", "off_route")


def distance_along(spark, sf_dir):
    points = S._points(spark, sf_dir).withColumn("shape_id", F.when(F.col("shape_id") != "7", F.col("shape_id")))
    twice = spark.range(25).where("id % 2 = 0").select(F.col("id").cast("string").alias("shape_id"))
    return SH.distance_along(points, S._shapes(spark), twice, ["vehicle_id", "seq"])


def chord_tangents(spark, sf_dir):
    places = S._points(spark, sf_dir).select("vehicle_id", "seq", "shape_id", F.col("expected_m").alias("along_m"))
    return SH.chord_tangent(places, S._shapes(spark), ["vehicle_id", "seq"])


def nearest_shapes(spark, sf_dir):
    """The distance from the vehicle's own shape, or where that is far, from the nearest of it and two candidates."""
    p = S._points(spark, sf_dir)
    own = SH.project(p, S._shapes(spark), ["vehicle_id", "seq"]).select("vehicle_id", "seq", F.col("off_m").alias("matched_off_m"))
    others = p.withColumn("shape_id", F.explode(F.array(*(((F.col("shape_id").cast("int") + i) % 25).cast("string") for i in (1, 2)))))
    near = SH.project(others, S._shapes(spark), ["vehicle_id", "seq"]).select("vehicle_id", "seq", "off_m")
    return SV.nearest_shape(own, near, ["vehicle_id", "seq"])


_QUERIES = {
    f.__name__: f
    for f in (
        serving_features, scheduled_remaining, terminus_predictions, trip_delay, dwell_lookup, bias_lookup, serving_rules, local_clock, trip_instances, schedule_versions, active_trips, vehicle_kinds, trip_stop_times, missing_days, older_columns,
        feed_repeats, stale_days, blended_arms, snapshot_sample, time_split_counts, offroute_by_trip, distance_along, chord_tangents, nearest_shapes,
    )
}

_ROUNDED = {"scheduled_remaining": ["sched_remaining_sec"], "serving_features": ["remaining_dist_m", "trip_progress_frac", "dist_per_stop_m", "sched_remaining_sec"], "distance_along": ["dist_m"], "chord_tangents": ["tangent"], "nearest_shapes": ["off_m"]}

_BUCKET = "('0x' || substr(md5({}), 1, 8))::BIGINT % 10000"
_SQL = {
    "serving_features": with_(*SERVED)
    + """SELECT vehicle_id, trip_id, seq, stop_id, stop_sequence, stops_ahead::INT AS stops_ahead, stops_remaining::INT AS stops_remaining, hour, (isodow(service_date) - 1)::INT AS day_of_week, (isodow(service_date) >= 6)::INT AS is_weekend, month(service_date)::INT AS month,
         (month(service_date) * 100 + day(service_date) IN (101, 107, 308, 501, 509, 628, 824, 1014, 1225))::INT AS is_holiday, stop_dist_m - dist_m AS remaining_dist_m, stop_dist_m / 3900.0::DOUBLE AS trip_progress_frac, (stop_dist_m - dist_m) / stops_ahead AS dist_per_stop_m,
         greatest(cum_sec - (k * 60 + k * k % 7 + (dist_m - k * 100) / 100 * (60 + (k + 1) * (k + 1) % 7 - k * k % 7)), 0) AS sched_remaining_sec FROM (SELECT *, floor(dist_m / 100)::BIGINT AS k FROM ahead)""",
    "scheduled_remaining": with_(*TRIPS)
    + """SELECT vehicle_id, trip_id, seq, stop_sequence, greatest(stop_sequence * 60 + stop_sequence * stop_sequence % 7 - (k * 60 + k * k % 7 + (dist_m - k * 100) / 100 * (60 + (k + 1) * (k + 1) % 7 - k * k % 7)), 0)::DOUBLE AS sched_remaining_sec
         FROM (SELECT *, floor(dist_m / 100)::BIGINT AS k FROM training)""",
    "terminus_predictions": with_(*SERVED) + "SELECT vehicle_id, trip_id, seq, stop_id, stop_sequence, stops_ahead::INT AS stops_ahead, until_departure + cum_sec AS seconds FROM leaves WHERE off_m <= 150 AND abs(dist_m) <= 50 AND until_departure IS NOT NULL",
    "trip_delay": with_(*SERVED) + "SELECT vehicle_id, trip_id, seq, CASE WHEN route_type IN (0, 11) THEN trunc(t + (stop_dist_m - dist_m) / 5.0::DOUBLE - (t - departure_sec % 700 + cum_sec))::INT END AS delay_sec FROM ahead WHERE stops_ahead = 1",
    "dwell_lookup": "SELECT o_orderkey, (o_orderkey % 13)::INT AS route_type, CASE o_orderkey % 13 WHEN 0 THEN 32 WHEN 3 THEN 27 ELSE 28 END::INT AS dwell_sec FROM orders",
    "bias_lookup": """SELECT o_orderkey, o_orderdate::DATE AS service_date, h AS stops_ahead, CASE WHEN isodow(o_orderdate) >= 6 THEN CASE WHEN h = 0 THEN 0 WHEN h = 1 THEN 10 ELSE 20 END ELSE CASE WHEN h = 2 THEN 5 WHEN h > 2 THEN 15 ELSE 0 END END::INT AS bias_sec
        FROM (SELECT *, (o_custkey % 12)::INT AS h FROM orders)""",
    "serving_rules": with_(B.FIXES_SQL, VEHICLES_SQL.split("timed AS")[0].rstrip().rstrip(","))
    + """SELECT vehicle_id, seq, there AS at_first_stop, source, CASE source WHEN 'schedule' THEN 150 WHEN 'idle' THEN 400 ELSE CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN 20 WHEN 2 THEN 35 ELSE 60 END END::INT AS band_sec,
         concat_ws(',', greatest(a, now + 1), greatest(greatest(a, b), now + 1), greatest(greatest(a, b, c), now + 1)) AS arrivals, seq % 5 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0 AS usable
       FROM (SELECT *, CASE WHEN resting AND NOT there THEN 'withheld' WHEN resting AND until_departure IS NOT NULL THEN 'schedule' WHEN resting THEN 'idle' ELSE 'model' END AS source,
               trunc(now + (off_m - 200))::BIGINT AS a, trunc(now + off_m / 2)::BIGINT AS b, trunc(now + (off_m + 60))::BIGINT AS c
             FROM (SELECT *, floor(t)::BIGINT AS now, off_m <= 150 AND dist_m <= 50 AS there, seq % 3 = 0 AND dist_m < 20 AS resting,
                     CASE WHEN route_type IN (0, 11) AND ((departure_sec - now_sec + 43200) % 86400 + 86400) % 86400 - 43200 BETWEEN -120 AND 1800 THEN 1 END AS until_departure FROM vehicles))""",
    "local_clock": """SELECT o_orderkey, (hour(l) * 3600 + minute(l) * 60 + second(l))::INT AS local_sec, strftime((date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 75000 + 14400)) AT TIME ZONE 'Europe/Kyiv' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS instant,
        CASE WHEN o_orderkey % 7 > 0 THEN (o_orderdate::DATE + 1)::DATE END AS next_day FROM (SELECT *, (o_orderdate + to_seconds(o_orderkey % 86400)) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv' AS l FROM orders)""",
    "trip_instances": with_(S.STOP_TIMES_SQL)
    + """SELECT trip_id, stop_sequence, start_date, format('{:02d}:{:02d}:{:02d}', departs // 3600, departs % 3600 // 60, departs % 60) AS start_time, strftime((start_date::TIMESTAMP + to_seconds(sec)) AT TIME ZONE 'Europe/Kyiv' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS scheduled
         FROM (SELECT *, CASE WHEN departs - trip_id::BIGINT * 97 % 86400 > 43200 THEN DATE '2024-03-30' ELSE DATE '2024-03-31' END AS start_date FROM (SELECT *, first(sec) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS departs FROM stop_times))""",
    "schedule_versions": """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT d.day, strftime(v.day, '%Y%m%d') AS version FROM d ASOF LEFT JOIN (SELECT day FROM d WHERE day(day) = 5) v ON d.day >= v.day""",
    "active_trips": f"""SELECT day, (trip_id::BIGINT % 25)::VARCHAR AS route_id, trip_id FROM ({S.SQL['active_services']}) a JOIN ({S.SQL['trips_running']}) r ON a.service_id = 'svc' || (r.trip_id::BIGINT % 12)::VARCHAR WHERE day = DATE '2024-01-09' AND running""",
    "vehicle_kinds": "SELECT o_orderkey::VARCHAR AS route_id, CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_orderkey % 4 END::INT AS route_type FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0",
    "trip_stop_times": with_(S.STOP_TIMES_SQL) + "SELECT trip_id, stop_id, stop_sequence, format('{:02d}:{:02d}:{:02d}', sec // 3600, sec % 3600 // 60, sec % 60) AS arrival_time FROM stop_times WHERE trip_id IN ('1', '2', '3', '33')",
    "missing_days": "SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE day(o_orderdate) % 3 <> 0",
    "older_columns": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id / 2.0::DOUBLE END AS stationary_sec FROM events",
    "feed_repeats": "SELECT * FROM (SELECT o_orderkey % 7 AS source, o_orderkey AS polled_at, o_orderkey // 20 AS feed_ts FROM orders) QUALIFY coalesce(lag(feed_ts) OVER (PARTITION BY source ORDER BY polled_at) <> feed_ts, true)",
    "stale_days": "SELECT o_orderdate::DATE AS service_date, quantile_cont(o_orderkey * 7 % 250, 0.5)::DOUBLE AS median_age_sec, median_age_sec > 120 AS is_stale FROM orders GROUP BY 1",
    "blended_arms": """SELECT l_orderkey, l_linenumber, q * 150 - 600 AS a, (p % 3000)::DOUBLE AS b, least(greatest(0.5::DOUBLE * (q * 150 - 600) + 0.5::DOUBLE * (p % 3000), 0), 3600) AS blend
        FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2) WHERE l_linenumber <> 2 AND p % 5 > 0""",
    "snapshot_sample": f"SELECT l_orderkey, count(*) AS n FROM lineitem WHERE {_BUCKET.format('l_orderkey::VARCHAR')} < 2500 GROUP BY 1",
    "time_split_counts": with_(B.FIXES_SQL, " r AS (SELECT * REPLACE (CASE WHEN day(service_date) >= 25 THEN route_id || 'n' ELSE route_id END AS route_id) FROM fixes)", " days AS (SELECT service_date, row_number() OVER (ORDER BY service_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT service_date FROM fixes))", " cut AS (SELECT service_date AS c FROM days WHERE k = floor(n * 0.8))")
    + f"""SELECT service_date, service_date < c OR (route_id NOT IN (SELECT route_id FROM r, cut WHERE service_date < c) AND {_BUCKET.format("vehicle_id || '|' || trip_id || '|' || seq")} < 8000) AS is_train, count(*) AS n FROM r, cut GROUP BY 1, 2""",
    "offroute_by_trip": with_(B.FIXES_SQL.replace("user_id::VARCHAR AS vehicle_id,", "user_id::VARCHAR || '-' || (date_diff('day', TIMESTAMP '2024-01-01', ts) // 10)::VARCHAR AS vehicle_id,"), STATUS_SQL, recursive=True) + "SELECT vehicle_id AS trip_id, seq, t, off_route FROM folded",
    "distance_along": with_(S.SHAPES_SQL)
    + """SELECT p.vehicle_id, p.seq, COALESCE(CASE WHEN p.shape_id = '7' THEN 0 WHEN p.shape_id::INT % 2 = 0 THEN b.along_m ELSE a.along_m END, 0) AS dist_m FROM points p
         LEFT JOIN (SELECT vehicle_id, seq, along_m FROM near_segs QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY off_m, seg) = 1) a USING (vehicle_id, seq)
         LEFT JOIN (SELECT vehicle_id, seq, along_m FROM (SELECT *, min(off_m) OVER (PARTITION BY vehicle_id, seq) AS least FROM near_segs) WHERE off_m <= least + 30 QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY abs(along_m - expected_m), seg) = 1) b USING (vehicle_id, seq)""",
    "chord_tangents": with_(S.SHAPES_SQL, " whole AS (SELECT shape_id, max(start_m + len_m) AS length_m FROM segs GROUP BY 1)", """ ends AS (SELECT vehicle_id, seq, p.shape_id, e, CASE e WHEN 0 THEN greatest(expected_m - least(5, length_m * 0.01), 0) ELSE least(expected_m + least(5, length_m * 0.01), length_m) END AS m FROM points p JOIN whole USING (shape_id), (VALUES (0), (1)) x(e))""",
        """ chord AS (SELECT vehicle_id, seq, e, ax + (m - start_m) / len_m * (bx - ax) AS x, ay + (m - start_m) / len_m * (yb - ay) AS y FROM ends JOIN segs USING (shape_id) WHERE m >= start_m AND m <= start_m + len_m QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq, e ORDER BY seg) = 1)""")
    + "SELECT vehicle_id, seq, (degrees(atan2(max(x) FILTER (e = 1) - max(x) FILTER (e = 0), max(y) FILTER (e = 1) - max(y) FILTER (e = 0))) + 360) % 360 AS tangent FROM chord GROUP BY 1, 2",
    "nearest_shapes": with_(S.SHAPES_SQL, " three AS (SELECT vehicle_id, seq, x, y, i, ((shape_id::INT + i) % 25)::VARCHAR AS shape_id FROM points, range(0, 3) r(i))", """ far AS (SELECT vehicle_id, seq, i, min(sqrt((x - (ax + s * (bx - ax))) ** 2 + (y - (ay + s * (yb - ay))) ** 2)) AS off_m
         FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2))) AS s FROM three JOIN segs USING (shape_id)) GROUP BY 1, 2, 3)""")
    + "SELECT vehicle_id, seq, CASE WHEN max(off_m) FILTER (i = 0) <= 100 THEN max(off_m) FILTER (i = 0) ELSE min(off_m) END AS off_m FROM far GROUP BY 1, 2",
}

QUERIES = rounded_queries(_QUERIES, _ROUNDED)
SQL = rounded_sql(_SQL, _ROUNDED)
