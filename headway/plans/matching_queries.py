"""Queries for matching with a fast path and for the grid of shapes, over trips and shapes that grow with the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway import constants as K
from headway.operators import matching as M
from headway.operators import schedule as SC
from headway.operators import shapes as SH
from headway.plans import schedule_queries as S
from headway.plans import testbed as B
from headway.plans.rounding import rounded_queries, rounded_sql
from headway.plans.trajectory_queries import with_
from headway.staging import written


def _network(spark, sf_dir, asked=None):
    """A customer is a route, its orders are the trips on two shapes of 40 points, and its trips' stops are their lines.

    With ``asked(shape_id)``, points are made for these shapes only: forty rows a shape, most of which no fix ever meets.
    """
    o = B.read(spark, sf_dir, "orders")
    route, shape = F.col("o_custkey").cast("string"), F.concat_ws("-", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 2).cast("string"))
    trips = o.select(F.col("o_orderkey").cast("string").alias("trip_id"), route.alias("route_id"), shape.alias("shape_id"), F.concat(F.lit("svc"), (F.col("o_orderkey") % 12).cast("string")).alias("service_id"))
    p = o.select(shape.alias("shape_id"), "o_custkey", (F.col("o_orderkey") % 2).alias("k")).distinct()
    p = (p if asked is None else SH.of_shapes(p, asked)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(S.POINTS - 1))))
    segs = SH.segments(p.select("shape_id", F.col("i").alias("seq"), (F.col("i") * 1000.0).alias("x"), ((F.col("o_custkey") * 37 + F.col("i") * 53 + F.col("k") * 5) % 11 * 100.0).alias("y")))
    return trips, segs, S._stop_times(spark, sf_dir)


def _seen(spark, sf_dir):
    """Events as fixes: some without route, place or bearing, reported on trips of their route near and far."""
    e, id_ = B.read(spark, sf_dir, "events"), F.col("event_id")
    some = lambda value, every: F.when(id_ % every != 0, value)
    return e.select(
        F.col("user_id").cast("string").alias("vehicle_id"), id_.alias("seq"), some(F.col("user_id").cast("string"), 23).alias("route_id"), some((id_ * 7919 % 39000).cast("double"), 29).alias("x"), (id_ * 104729 % 1100).cast("double").alias("y"),
        some((id_ * 37 % 360).cast("double"), 9).alias("bearing"), some((id_ * 31 % 20_000).cast("string"), 5).alias("reported_trip_id"), F.to_date("ts").alias("day"), (id_ * 97 % 86_400).cast("int").alias("now_sec"),
    )


def route_index(spark, sf_dir):
    """The trips of each route; every eleventh has no stop times."""
    trips, _, stop_times = _network(spark, sf_dir)
    return SC.route_index(trips, stop_times.where("cast(trip_id AS bigint) % 11 <> 0"))


def tracked_trips(spark, sf_dir):
    """Every fix of a vehicle's month with its trip and status; some have no place, and some no candidates."""
    seq = F.col("seq")
    months = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.trunc(F.to_date("ts"), "month").alias("day"))
    scored = S._candidates(spark, sf_dir).join(months, "seq")
    fixes = S._points(spark, sf_dir).join(months, "seq").select("vehicle_id", "day", "seq", seq.cast("double").alias("t"), F.when(seq % 13 != 0, F.col("shape_id")).alias("route_id"), F.when(seq % 19 != 0, F.col("x")).alias("x"), "y")
    own = (F.col("trip_id") == F.col("reported_trip_id")) & (F.col("off_m") < K.FAST_PATH_DIST_M)
    return M.tracked_trips(fixes, scored.where("seq % 17 <> 0").select("vehicle_id", "day", "seq", "trip_id", "score", "off_m", "bearing_diff", own.alias("trusted")))


TRACKED_SQL = """
fx AS (SELECT user_id::VARCHAR AS vehicle_id, date_trunc('month', ts)::DATE AS day, event_id AS seq, event_id % 13 <> 0 AND event_id % 19 <> 0 AS placed FROM events),
cs AS (SELECT s.vehicle_id, f.day, s.seq, trip_id, off_m, least((bearing - tangent + 360) % 360, 360 - (bearing - tangent + 360) % 360) AS diff, trip_id = (s.seq % 100)::VARCHAR AND off_m < 50 AS sure, CASE WHEN trip_id = (s.seq % 100)::VARCHAR AND off_m < 50 THEN off_m / 100.0 ELSE score END AS score
       FROM scored s JOIN fx f ON f.seq = s.seq WHERE placed AND s.seq % 17 <> 0),
picks AS (SELECT vehicle_id, day, seq, trip_id AS p_trip, off_m AS p_off, diff AS p_diff, sure, score AS p_score FROM cs WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, score, trip_id) = 1),
placed0 AS (SELECT f.*, p_trip, p_off, p_diff, COALESCE(sure, false) AS sure, p_score, CASE WHEN sure THEN p_off ELSE COALESCE(m, 'inf'::DOUBLE) END AS d FROM fx f LEFT JOIN picks USING (vehicle_id, day, seq) LEFT JOIN (SELECT seq, min(off_m) AS m FROM cs GROUP BY 1) USING (seq) WHERE placed),
ways AS (SELECT *, d > 150 OR COALESCE(d > lag(d) OVER w AND lag(d) OVER w > lag(d, 2) OVER w AND d > 100, false) AS far, row_number() OVER w AS rn FROM placed0 WINDOW w AS (PARTITION BY vehicle_id, day ORDER BY seq)),
run AS (SELECT vehicle_id, day, 0::BIGINT AS seq, 0::BIGINT AS rn, NULL::VARCHAR AS trip, false AS off, 0 AS n, NULL::DOUBLE AS score, NULL::DOUBLE AS off_m FROM ways WHERE rn = 1
  UNION ALL
  SELECT vehicle_id, day, seq, rn, CASE WHEN off <> turn THEN NULL ELSE trip END, off <> turn, CASE WHEN signal AND NOT turn THEN n + 1 ELSE 0 END, score, off_m
  FROM (SELECT *, signal AND n + 1 >= 3 AS turn FROM (SELECT *, CASE WHEN off THEN d <= 100 ELSE far OR COALESCE(diff > 90 AND d > 50, false) END AS signal FROM (
    SELECT w.vehicle_id, w.day, w.seq, w.rn, r.off, r.n, w.d, w.far, CASE WHEN stays THEN b.trip_id ELSE p_trip END AS trip, CASE WHEN stays THEN b.score ELSE p_score END AS score, CASE WHEN stays THEN b.off_m ELSE p_off END AS off_m, CASE WHEN stays THEN b.diff ELSE p_diff END AS diff
    FROM run r JOIN ways w ON w.vehicle_id = r.vehicle_id AND w.day = r.day AND w.rn = r.rn + 1 LEFT JOIN cs b ON b.seq = w.seq AND b.trip_id = r.trip,
         LATERAL (SELECT COALESCE(NOT w.sure AND b.off_m <= 150 AND b.off_m <= COALESCE(w.p_off, 'inf'::DOUBLE), false) AS stays) q))))"""


def _matched(spark, sf_dir, mode):
    seen = _seen(spark, sf_dir)
    trips, _, stop_times = _network(spark, sf_dir)
    trips = written(M.trips_asked(seen, trips), "trips-asked")
    segs = _network(spark, sf_dir, trips)[1]
    stop_times = stop_times.join(trips, "trip_id", "left_semi")
    services = SC.active_services(S._calendar(spark), S._exceptions(spark), seen.select("day").distinct())
    out = M.match_fixes(seen, trips, segs, services, SC.bounds(stop_times), SC.profiles(stop_times), mode)
    return out.select("vehicle_id", "seq", "path", "trip_id", "off_m", "score", "min_off_m")


def match_batch(spark, sf_dir):
    return _matched(spark, sf_dir, "batch")


def match_live(spark, sf_dir):
    return _matched(spark, sf_dir, "live")


def match_paths(spark, sf_dir):
    """How many fixes go which way in either mode; together they are all fixes."""
    both = [_matched(spark, sf_dir, mode).groupBy(F.lit(mode).alias("mode"), "path").agg(F.count("*").alias("n")) for mode in ("batch", "live")]
    return both[0].unionByName(both[1])


def active_trips_by_fix(spark, sf_dir):
    """How many trips of a fix's route run when it is seen, over all days and seconds, and the first of them."""
    trips, _, stop_times = _network(spark, sf_dir)
    seen = _seen(spark, sf_dir).select("vehicle_id", "seq", "route_id", "day", "now_sec")
    services = SC.active_services(S._calendar(spark), S._exceptions(spark), seen.select("day").distinct())
    times = SC.bounds(stop_times).withColumn("last_sec", F.when(F.col("trip_id").cast("long") % 7 != 0, F.col("last_sec")))  # some ends are unknown
    return SC.trips_at(seen, trips.drop("shape_id"), services, times).groupBy("vehicle_id", "seq").agg(F.count("*").alias("n_active"), F.min("trip_id").alias("first_trip"))


def _on_shapes(spark, sf_dir):
    seen = _seen(spark, sf_dir).where("route_id IS NOT NULL")
    return seen.select("vehicle_id", "seq", F.concat_ws("-", "route_id", (F.col("seq") % 2).cast("string")).alias("shape_id"), "x", F.when(F.col("seq") % 50 == 0, F.col("y") + 5000).otherwise(F.col("y")).alias("y"))


def grid_match(spark, sf_dir):
    """Each fix on one of its route's shapes by the grid, some far from any; the SQL compares every segment."""
    points = _on_shapes(spark, sf_dir)
    return SH.project_by_cells(points, _network(spark, sf_dir, points)[1], ["vehicle_id", "seq"])


QUERIES = {f.__name__: f for f in (match_batch, match_live, match_paths, active_trips_by_fix, grid_match, route_index, tracked_trips)}

_SHARE = "greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / ((bx - ax) ** 2 + (yb - ay) ** 2)))"
NETWORK_SQL = f"""
ways AS (SELECT o_orderkey::VARCHAR AS trip_id, o_custkey::VARCHAR AS route_id, o_custkey::VARCHAR || '-' || (o_orderkey % 2)::VARCHAR AS shape_id, 'svc' || (o_orderkey % 12)::VARCHAR AS service_id FROM orders),
pts AS (SELECT shape_id, i AS seg, i * 1000.0::DOUBLE AS ax, ((c * 37 + i * 53 + k * 5) % 11) * 100.0::DOUBLE AS ay FROM (SELECT DISTINCT o_custkey::VARCHAR || '-' || (o_orderkey % 2)::VARCHAR AS shape_id, o_custkey AS c, o_orderkey % 2 AS k FROM orders), range(40) r(i)),
seg0 AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS yb FROM pts WINDOW w AS (PARTITION BY shape_id ORDER BY seg)),
segs AS (SELECT *, sqrt((bx - ax) ** 2 + (yb - ay) ** 2) AS len_m, COALESCE(sum(sqrt((bx - ax) ** 2 + (yb - ay) ** 2)) OVER (PARTITION BY shape_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM seg0 WHERE bx IS NOT NULL),
seen AS (SELECT user_id::VARCHAR AS vehicle_id, event_id AS seq, CASE WHEN event_id % 23 <> 0 THEN user_id::VARCHAR END AS route_id, CASE WHEN event_id % 29 <> 0 THEN (event_id * 7919 % 39000)::DOUBLE END AS x, (event_id * 104729 % 1100)::DOUBLE AS y,
         CASE WHEN event_id % 9 <> 0 THEN (event_id * 37 % 360)::DOUBLE END AS bearing, CASE WHEN event_id % 5 <> 0 THEN (event_id * 31 % 20000)::VARCHAR END AS reported_trip_id, ts::DATE AS day, (event_id * 97 % 86400)::INT AS now_sec FROM events)"""


def _match_sql(mode: str) -> str:
    live = mode == "live"
    believable = "off_m < 75 AND (bearing IS NULL OR least((bearing - tangent + 360) % 360, 360 - (bearing - tangent + 360) % 360) <= 90)" if live else "off_m < 50"
    spatial = "least(off_m / 100.0, 5)" if live else "off_m / 100.0"
    return with_(
        NETWORK_SQL, S.STOP_TIMES_SQL, f" active AS ({S.SQL['active_services']})",
        f"""
own AS (SELECT s.*, w.shape_id FROM seen s JOIN ways w ON w.trip_id = s.reported_trip_id {'JOIN active a ON a.day = s.day AND a.service_id = w.service_id' if live else ''} WHERE s.route_id IS NOT NULL AND s.x IS NOT NULL),
ownseg AS (SELECT o.*, g.seg, (degrees(atan2(bx - ax, yb - ay)) + 360) % 360 AS tangent, {_SHARE} AS share, ax, ay, bx, yb FROM own o JOIN segs g ON g.shape_id = o.shape_id),
ownoff AS (SELECT *, sqrt((x - (ax + share * (bx - ax))) ** 2 + (y - (ay + share * (yb - ay))) ** 2) AS off_m FROM ownseg QUALIFY row_number() OVER (PARTITION BY seq ORDER BY off_m, seg) = 1),
sure AS (SELECT seq, reported_trip_id AS trip_id, off_m, off_m / 100.0 AS score, off_m AS min_off_m FROM ownoff WHERE {believable}),
ends AS (SELECT trip_id, arg_min(sec, stop_sequence) AS first_sec, arg_max(sec, stop_sequence) AS last_sec FROM stop_times GROUP BY trip_id),
tb AS (SELECT e.*, p FROM ends e LEFT JOIN (SELECT trip_id, list(struct_pack(x := cum_sec::DOUBLE, y := dist_m) ORDER BY cum_sec, dist_m) AS p FROM profile GROUP BY trip_id) USING (trip_id)),
asked AS (SELECT s.seq, s.x, s.y, s.bearing, w.trip_id, w.shape_id, p, (now_sec - first_sec)::DOUBLE AS now_s, len(list_filter(p, lambda q: q.x <= now_sec - first_sec)) AS k FROM seen s JOIN ways w ON w.route_id = s.route_id JOIN active a ON a.day = s.day AND a.service_id = w.service_id LEFT JOIN tb ON tb.trip_id = w.trip_id
          WHERE s.x IS NOT NULL AND s.seq NOT IN (SELECT seq FROM sure) {'' if live else 'AND COALESCE(now_sec BETWEEN first_sec - 600 AND last_sec + 1800, true)'}),
hoped AS (SELECT *, CASE WHEN p IS NULL OR len(p) < 2 THEN NULL WHEN k = 0 THEN p[1].y WHEN k = len(p) THEN p[k].y ELSE p[k].y + (now_s - p[k].x) / (p[k + 1].x - p[k].x) * (p[k + 1].y - p[k].y) END AS expected_m FROM asked),
pairs AS (SELECT DISTINCT seq, shape_id, x, y FROM hoped),
pseg AS (SELECT r.*, g.seg, start_m, len_m, (degrees(atan2(bx - ax, yb - ay)) + 360) % 360 AS tangent, {_SHARE} AS share, ax, ay, bx, yb FROM pairs r JOIN segs g ON g.shape_id = r.shape_id),
poff AS (SELECT seq, shape_id, sqrt((x - (ax + share * (bx - ax))) ** 2 + (y - (ay + share * (yb - ay))) ** 2) AS off_m, start_m + share * len_m AS along_m, tangent FROM pseg QUALIFY row_number() OVER (PARTITION BY seq, shape_id ORDER BY off_m, seg) = 1),
lens AS (SELECT shape_id, max(start_m + len_m) AS length_m FROM segs GROUP BY 1),
rated AS (SELECT h.seq, h.trip_id, off_m, {'' if live else 'CASE WHEN off_m <= 100 THEN '} 0.4 * ({spatial}) + 0.3 * CASE WHEN bearing IS NULL THEN 0.5 ELSE least((bearing - tangent + 360) % 360, 360 - (bearing - tangent + 360) % 360) / 180.0 END + 0.3 * CASE WHEN expected_m IS NULL THEN 0.5 ELSE least(abs(along_m - expected_m) / greatest(length_m, 1.0), 1.0) END {'' if live else 'END'} AS score
          FROM hoped h JOIN poff USING (seq, shape_id) JOIN lens USING (shape_id)),
best AS (SELECT *, min(off_m) OVER (PARTITION BY seq) AS min_off_m FROM rated QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score NULLS LAST, trip_id) = 1),
matched AS (SELECT s.vehicle_id, s.seq, CASE WHEN s.route_id IS NULL OR s.x IS NULL THEN 'unplaced' WHEN u.seq IS NOT NULL THEN 'reported' WHEN b.score IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS path,
            CASE WHEN u.seq IS NOT NULL THEN u.trip_id WHEN b.score IS NOT NULL THEN b.trip_id END AS trip_id, CASE WHEN u.seq IS NOT NULL THEN u.off_m WHEN b.score IS NOT NULL THEN b.off_m END AS off_m, COALESCE(u.score, b.score) AS score, COALESCE(u.min_off_m, b.min_off_m) AS min_off_m
            FROM seen s LEFT JOIN sure u ON u.seq = s.seq LEFT JOIN best b ON b.seq = s.seq)""",
    )


SQL = {
    "tracked_trips": with_(S.SHAPES_SQL, S.SCORES_SQL, TRACKED_SQL, recursive=True)
    + """SELECT f.vehicle_id, f.day, f.seq, r.trip AS trip_id, r.score, r.off_m, COALESCE(r.off_m < 50 AND NOT r.off, false) AS high_confidence, COALESCE(r.off, false) AS off_route FROM fx f LEFT JOIN run r ON r.vehicle_id = f.vehicle_id AND r.day = f.day AND r.seq = f.seq AND r.rn > 0""",
    "route_index": with_(NETWORK_SQL, S.STOP_TIMES_SQL)
    + "SELECT route_id, trip_id, n_stops, first_stop_id, last_stop_id FROM ways JOIN (SELECT trip_id, count(*) AS n_stops, arg_min(stop_id, stop_sequence) AS first_stop_id, arg_max(stop_id, stop_sequence) AS last_stop_id FROM stop_times GROUP BY 1) USING (trip_id) WHERE trip_id::BIGINT % 11 <> 0",
    "match_batch": _match_sql("batch") + "SELECT * FROM matched",
    "match_live": _match_sql("live") + "SELECT * FROM matched",
    "match_paths": " UNION ALL ".join(f"SELECT '{mode}' AS mode, path, count(*) AS n FROM ({_match_sql(mode)} SELECT * FROM matched) GROUP BY 2" for mode in ("batch", "live")),
    "active_trips_by_fix": with_(NETWORK_SQL, S.STOP_TIMES_SQL, f" active AS ({S.SQL['active_services']})", " ends AS (SELECT trip_id, arg_min(sec, stop_sequence) AS first_sec, CASE WHEN trip_id::BIGINT % 7 <> 0 THEN arg_max(sec, stop_sequence) END AS last_sec FROM stop_times GROUP BY trip_id)")
    + """SELECT vehicle_id, seq, count(*) AS n_active, min(w.trip_id) AS first_trip FROM seen s JOIN ways w ON w.route_id = s.route_id JOIN active a ON a.day = s.day AND a.service_id = w.service_id LEFT JOIN ends e ON e.trip_id = w.trip_id
         WHERE COALESCE(now_sec BETWEEN first_sec - 600 AND last_sec + 1800, true) GROUP BY 1, 2""",
    "grid_match": with_(NETWORK_SQL, " onto AS (SELECT vehicle_id, seq, route_id || '-' || (seq % 2)::VARCHAR AS shape_id, x, CASE WHEN seq % 50 = 0 THEN y + 5000 ELSE y END AS y FROM seen WHERE route_id IS NOT NULL AND x IS NOT NULL)", f" g AS (SELECT o.*, seg, ax, ay, bx, yb, start_m, len_m, {_SHARE} AS share FROM onto o JOIN segs USING (shape_id))")
    + """SELECT vehicle_id, seq, shape_id, sqrt((x - (ax + share * (bx - ax))) ** 2 + (y - (ay + share * (yb - ay))) ** 2) AS off_m, start_m + share * len_m AS along_m, (degrees(atan2(bx - ax, yb - ay)) + 360) % 360 AS tangent FROM g
         QUALIFY row_number() OVER (PARTITION BY seq ORDER BY off_m, seg) = 1""",
}

_ROUNDED = {**{f"match_{m}": ["off_m", "score", "min_off_m"] for m in ("batch", "live")}, "grid_match": ["off_m", "along_m", "tangent"], "tracked_trips": ["off_m", "score"]}
QUERIES, SQL = rounded_queries(QUERIES, _ROUNDED), rounded_sql(SQL, _ROUNDED)
