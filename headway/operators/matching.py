"""Map matching: candidates, scores, and the vehicle's memory of its last trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway import constants as K
from headway.functions.geo import bearing_diff
from headway.operators import schedule, shapes
from headway.operators.folds import folded


def match_shapes(fixes: DataFrame, trips: DataFrame, segs: DataFrame) -> DataFrame:
    """``fixes`` with each trip of their route: ``trip_id, shape_id, off_m, along_m, tangent``.

    A route has hundreds of trips over a few shapes, so geometry is done for distinct (fix, shape) pairs, and the result
    is given to the trips. ``fixes(vehicle_id, seq, route_id, x, y)``, ``trips(trip_id, route_id, shape_id)``.
    """
    of_route = trips.select("route_id", "shape_id").distinct()
    points = fixes.select("vehicle_id", "seq", "route_id", "x", "y").join(of_route, "route_id")
    placed = shapes.project(points.drop("route_id"), segs, ["vehicle_id", "seq"])
    return fixes.join(trips.select("trip_id", "route_id", "shape_id"), "route_id").join(placed, ["vehicle_id", "seq", "shape_id"])


def trip_score(off_m: Column, diff: Column, along_m: Column, expected_m: Column, length_m: Column, profile: str = "batch") -> Column:
    """Weighed distance, heading and progress; half marks for what is unknown. Batch: infinite beyond MAX_DIST_M; live: the distance counts 5 at most."""
    near = off_m / K.MAX_DIST_M
    heading = F.coalesce(diff / 180.0, F.lit(0.5))
    share = F.abs(along_m - expected_m) / F.greatest(length_m, F.lit(1.0))
    progress = F.when(share.isNotNull(), F.least(share, F.lit(1.0))).otherwise(0.5)  # least() would pass over a null
    score = lambda d: K.SPATIAL_WEIGHT * d + K.BEARING_WEIGHT * heading + K.PROGRESS_WEIGHT * progress
    if profile == "live":
        return score(F.least(near, F.lit(5.0)))
    return F.when(off_m > K.MAX_DIST_M, float("inf")).otherwise(score(near))


def scored(candidates: DataFrame, lengths: DataFrame | None = None, profile: str = "batch", keep_zero_bearing: bool = True) -> DataFrame:
    """Adds ``bearing_diff`` and ``score`` to rows of :func:`match_shapes` with ``bearing``, ``expected_m``, and ``length_m`` where no ``lengths`` are given."""
    heading = F.col("bearing") if keep_zero_bearing else F.when(F.col("bearing") != 0, F.col("bearing"))
    rows = (candidates.join(lengths, "shape_id") if lengths is not None else candidates).withColumn("bearing_diff", bearing_diff(heading, F.col("tangent")))
    return rows.withColumn("score", trip_score(F.col("off_m"), F.col("bearing_diff"), F.col("along_m"), F.col("expected_m"), F.col("length_m"), profile))


def best_trip(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, trip_id, score, off_m, along_m, bearing_diff, min_off_m``: the least score, of equals the first trip id; none if all are infinite."""
    best = rows.groupBy(*keys).agg(F.min(F.struct("score", "trip_id", "off_m", "along_m", "bearing_diff")).alias("b"), F.min("off_m").alias("min_off_m"))
    known = F.col("b.score") < float("inf")
    return best.select(*keys, F.when(known, F.col("b.trip_id")).alias("trip_id"), "b.score", "b.off_m", "b.along_m", "b.bearing_diff", "min_off_m")


def trusted(rows: DataFrame, profile: str = "batch") -> DataFrame:
    """The candidates that are the reported trip and near enough to be believed without scoring the others."""
    own = rows.where(F.col("trip_id") == F.col("reported_trip_id"))
    if profile == "live":
        return own.where((F.col("off_m") < K.TRUST_DIST_M) & (F.coalesce(F.col("bearing_diff"), F.lit(0.0)) <= K.TRUST_BEARING_DEG))
    return own.where(F.col("off_m") < K.FAST_PATH_DIST_M)


def believable(off_m: Column, diff: Column, profile: str = "batch") -> Column:
    """Whether a fix so far from its reported trip's shape, and so turned against it, is that trip's without asking others."""
    if profile == "live":
        return (off_m < K.TRUST_DIST_M) & (F.coalesce(diff, F.lit(0.0)) <= K.TRUST_BEARING_DEG)
    return off_m < K.FAST_PATH_DIST_M


def trips_asked(fixes: DataFrame, trips: DataFrame) -> DataFrame:
    """The ``trips`` that ``fixes(route_id, reported_trip_id)`` may be of: those of their routes, and those reported.

    :func:`match_fixes` gives the same for them as for all trips, of which a network may have many more.
    """
    routes = fixes.select("route_id").where("coalesce(route_id, '') <> ''").distinct()
    reported = fixes.select(F.col("reported_trip_id").alias("trip_id")).where("trip_id IS NOT NULL").distinct()
    of = lambda some, key: trips.join(some, key, "left_semi").select(trips.columns)
    return of(routes, "route_id").unionByName(of(reported, "trip_id")).distinct()


def match_fixes(fixes: DataFrame, trips: DataFrame, segs: DataFrame, services: DataFrame, times: DataFrame, profile: DataFrame, mode: str = "batch") -> DataFrame:
    """``vehicle_id, seq, path, trip_id, off_m, bearing_diff, score, min_off_m``: one row for each fix, whatever becomes of it.

    ``fixes(vehicle_id, seq, route_id, x, y, bearing, reported_trip_id, day, now_sec)``, keyed by vehicle and seq;
    ``trips(trip_id, route_id, shape_id, service_id)``, ``services(day, service_id)``, ``times(trip_id, first_sec,
    last_sec)``, ``profile(trip_id, dist_m, cum_sec)``. ``path`` says how a fix went:

    ``unplaced``: without route or place; it meets no geometry at all. ``reported``: its reported trip is known and
    believable (``mode`` live: and in service that day), so it leaves before any candidate is joined. ``matched``: the
    best of the route's trips in service (batch: that run at ``now_sec``), of equals the first by id. ``unmatched``: no
    candidate, or in batch mode none within MAX_DIST_M; then ``min_off_m`` still has the nearest candidate's distance.
    """
    keys = ["vehicle_id", "seq"]
    placed = fixes.where("coalesce(route_id, '') <> '' AND x IS NOT NULL AND y IS NOT NULL")
    ways = trips.select("trip_id", "shape_id", "service_id", "route_id")
    own = placed.join(ways.select(F.col("trip_id").alias("reported_trip_id"), "shape_id", "service_id"), "reported_trip_id")
    if mode == "live":
        own = own.join(services, ["day", "service_id"], "left_semi")
    lines = shapes.lines(segs)
    at = shapes.on_lines_within(own, lines, [*keys, "reported_trip_id", "bearing"], K.TRUST_DIST_M)
    near = at.withColumn("bearing_diff", bearing_diff(F.col("bearing"), F.col("tangent")))
    sure = near.where(believable(F.col("off_m"), F.col("bearing_diff"), mode)).select(*keys, F.lit("reported").alias("path"), F.col("reported_trip_id").alias("trip_id"), "off_m", "bearing_diff", (F.col("off_m") / K.MAX_DIST_M).alias("score"), F.col("off_m").alias("min_off_m"))

    rest = placed.join(sure, keys, "left_anti")
    # A route has many trips over few shapes, so a fix gets its places first. Candidates are the most rows: what their
    # score needs comes to them with the fix and the trip, so that no join shuffles them.
    with_shapes = rest.join(ways.select("route_id", "shape_id").distinct(), "route_id")
    seen = shapes.on_lines(with_shapes, lines, [*keys, "route_id", "bearing", "day", "now_sec"])
    known = ways.join(shapes.lengths(segs), "shape_id").join(schedule.profile_arrays(profile, "cum_sec", "dist_m"), "trip_id", "left")
    if mode == "batch":
        asked = schedule.trips_at(seen, known, services, times, on=("route_id", "shape_id"))
    else:
        asked = schedule.in_service(seen.join(known.join(times, "trip_id", "left"), ["route_id", "shape_id"]), services)
    asked = asked.withColumn("elapsed_sec", schedule.elapsed(F.col("now_sec"), F.col("first_sec"), F.col("last_sec"))).withColumn("expected_m", F.expr(schedule.value_at("elapsed_sec")))
    best = best_trip(scored(asked, profile=mode), keys)
    found = F.col("trip_id").isNotNull()
    chosen = best.select(*keys, F.when(found, "matched").otherwise("unmatched").alias("path"), "trip_id", *(F.when(found, F.col(c)).alias(c) for c in ("off_m", "bearing_diff", "score")), "min_off_m")
    told = fixes.select(*keys, (F.coalesce("route_id", F.lit("")) != "").alias("routed"), (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("located")).join(sure.unionByName(chosen), keys, "left")
    return told.withColumn("path", F.coalesce("path", F.when(F.col("routed") & F.col("located"), "unmatched").otherwise("unplaced"))).drop("routed", "located")


def with_hysteresis(rows: DataFrame) -> DataFrame:
    """``vehicle_id, seq, trip_id, score, off_m, high_confidence``: per fix the trusted or best candidate, unless the
    trip before still fits: within 150 m and no farther off than the new one.

    Which trip the one before is depends on the choices made, so this is a fold over a vehicle's fixes in order; its
    candidates, a few dozen a fix, were scored before. ``rows`` has ``vehicle_id, seq, t, trip_id, score, off_m, trusted``.
    """
    runs = rows.groupBy("vehicle_id", "t", "seq").agg(F.array_sort(F.collect_list(F.struct("score", "trip_id", "off_m", "trusted"))).alias("c"))
    runs = runs.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "c"))).alias("f"))
    pick = "coalesce(try_element_at(filter(x.c, y -> y.trusted), 1), x.c[0])"
    before = "try_element_at(filter(x.c, y -> y.trip_id = s), 1)"
    stays = f"NOT coalesce({pick}.trusted, false) AND s IS NOT NULL AND {before}.off_m <= {K.HYSTERESIS_DIST_M} AND {before}.off_m <= CASE WHEN {pick}.score < double('inf') THEN {pick}.off_m ELSE double('inf') END"
    chosen = f"CASE WHEN coalesce({stays}, false) THEN {before} ELSE {pick} END"
    found = f"CASE WHEN coalesce({stays}, false) OR {pick}.score < double('inf') THEN {chosen}.trip_id END"
    out = f"named_struct('seq', x.seq, 'trip_id', {found}, 'score', {chosen}.score, 'off_m', {chosen}.off_m)"
    kept = folded("f", "cast(null AS string)", f"coalesce({found}, s)", out, "struct<seq:bigint,trip_id:string,score:double,off_m:double>")
    return runs.select("vehicle_id", F.inline(kept)).withColumn("high_confidence", F.col("off_m") < K.MAX_DIST_M / 2)


def tracked_trips(fixes: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("vehicle_id", "day")) -> DataFrame:
    """``keys, seq, trip_id, score, off_m, high_confidence, off_route`` of every fix: its trip, and whether it is on its way at all.

    ``fixes(keys, seq, t, route_id, x, y)``, ``candidates(keys, seq, trip_id, score, off_m, bearing_diff, trusted)``. A
    trusted candidate is taken, its score its distance over MAX_DIST_M; else the best, unless the trip before is a
    candidate within HYSTERESIS_DIST_M and no farther off. The least distance of a fix, infinite without candidates, and
    the heading against the trip taken feed the off-route status; while that is on, a fix has no trip and none is
    remembered. A fix without route or place keeps its row, with no trip and on route, and changes nothing of what
    follows. Without any candidate near enough ``trip_id`` is null; ``score, off_m`` are null where nothing was taken.

    What is remembered starts anew with each of ``keys``: by day, so that a task folds a vehicle's day and no more.
    """
    one = ["score", "trip_id", "off_m", "bearing_diff", "trusted"]
    c = F.array_sort(F.collect_list(F.struct(F.when(F.col("trusted"), F.col("off_m") / K.MAX_DIST_M).otherwise(F.col("score")).alias("score"), *one[1:])))
    met = candidates.withColumn("trusted", F.coalesce("trusted", F.lit(False))).groupBy(*keys, "seq").agg(c.alias("c"))
    each = ", ".join(keys)
    inf = "double('inf')"
    kind = "struct<score:double,trip_id:string,off_m:double,bearing_diff:double,trusted:boolean>"
    rows = fixes.select(*keys, "seq", "t", F.expr("coalesce(route_id, '') <> '' AND x IS NOT NULL AND y IS NOT NULL").alias("placed")).join(met, [*keys, "seq"], "left")
    rows = rows.withColumn("c", F.expr("IF(placed, coalesce(c, array()), array())"))
    rows = rows.withColumn("pick", F.expr(f"coalesce(try_element_at(filter(c, y -> y.trusted), 1), try_element_at(filter(c, y -> y.score < {inf}), 1))"))
    rows = rows.withColumn("d", F.expr(f"CASE WHEN placed THEN IF(coalesce(pick.trusted, false), pick.off_m, coalesce(array_min(transform(c, y -> y.off_m)), {inf})) END"))
    before = lambda n: f"lag(d, {n}) IGNORE NULLS OVER (PARTITION BY {each} ORDER BY t, seq)"
    rows = rows.withColumn("far", F.expr(f"coalesce(d > {K.OFF_ROUTE_DIST_M} OR (d > {before(1)} AND {before(1)} > {before(2)} AND d > {K.ON_ROUTE_DIST_M}), false)"))
    runs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "seq", "placed", "c", "pick", "d", "far"))).alias("f"))

    last = "try_element_at(filter(x.c, y -> y.trip_id = s.trip), 1)"
    stays = f"NOT coalesce(x.pick.trusted, false) AND s.trip IS NOT NULL AND {last}.off_m <= {K.HYSTERESIS_DIST_M} AND {last}.off_m <= coalesce(x.pick.off_m, {inf})"
    signal = f"IF(s.off, x.d <= {K.ON_ROUTE_DIST_M}, x.far OR coalesce(g.bearing_diff > {K.BEARING_WRONG_DEG} AND x.d > {K.BEARING_MIN_DIST_M}, false))"
    turns = f"h AND s.n + 1 >= IF(s.off, {K.ON_ROUTE_CONSEC}, {K.OFF_ROUTE_CONSEC})"
    after = "named_struct('trip', IF(s.off <> w, cast(null AS string), g.trip_id), 'off', s.off <> w, 'n', IF(h AND NOT w, s.n + 1, 0), 'got', g)"
    moved = f"transform(array(IF(coalesce({stays}, false), {last}, x.pick)), g -> transform(array({signal}), h -> transform(array({turns}), w -> {after})[0])[0])[0]"
    state = f"struct<trip:string,off:boolean,n:int,got:{kind}>"
    start = f"cast(named_struct('trip', null, 'off', false, 'n', 0, 'got', null) AS {state})"
    step = f"IF(x.placed, cast({moved} AS {state}), cast(named_struct('trip', s.trip, 'off', s.off, 'n', s.n, 'got', null) AS {state}))"
    out = f"named_struct('seq', x.seq, 'trip_id', IF(x.placed, n.trip, null), 'score', nullif(n.got.score, {inf}), 'off_m', n.got.off_m, 'high_confidence', coalesce(n.got.off_m < {K.MAX_DIST_M / 2} AND NOT n.off, false), 'off_route', x.placed AND n.off)"
    done = folded("f", start, step, out, "struct<seq:bigint,trip_id:string,score:double,off_m:double,high_confidence:boolean,off_route:boolean>")
    return runs.select(*keys, F.inline(done))
