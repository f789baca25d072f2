"""Operators over trajectories: rows of one (vehicle_id, trip_id) in the order of ``t`` (epoch seconds) and ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from headway import constants as K
from headway.operators.folds import folded, folded_in_blocks
from headway.operators.quantiles import quantiles

TRAJECTORY = ("vehicle_id", "trip_id")


def along(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or TRAJECTORY)).orderBy("t", "seq")


def progress_speed(fixes: DataFrame, min_gap=K.SPEED_MIN_GAP_SEC, max_gap=K.SPEED_MAX_GAP_SEC, max_backward=K.SPEED_MAX_BACKWARD_M) -> DataFrame:
    """Adds ``progress_speed_mps`` over the previous fix; SPEED_UNKNOWN for the first, odd gaps, and jumps back."""
    w = along()
    dt, dd = F.col("t") - F.lag("t").over(w), F.col("dist_m") - F.lag("dist_m").over(w)
    speed = F.when(dt.between(min_gap, max_gap) & (dd >= -max_backward), F.greatest(F.lit(0.0), dd) / dt)
    return fixes.withColumn("progress_speed_mps", F.coalesce(speed, F.lit(K.SPEED_UNKNOWN)))


def stationary_seconds(fixes: DataFrame, eps: float = K.MOVE_EPS_M) -> DataFrame:
    """``vehicle_id, trip_id, seq, stationary_sec``: time since the vehicle last advanced by more than ``eps``.

    The anchor is a fold, not a lag: it moves only when the distance from it exceeds ``eps``. The fold runs over the
    sorted fixes of one trajectory, which a service day bounds.
    """
    runs = fixes.groupBy(*TRAJECTORY).agg(F.sort_array(F.collect_list(F.struct("t", "seq", F.col("dist_m").alias("d")))).alias("f"))
    moved = f"IF(x.d - s.d > {eps}, named_struct('t', x.t, 'd', x.d), s)"
    still = folded("f", "named_struct('t', f[0].t, 'd', f[0].d)", moved, "named_struct('seq', x.seq, 's', x.t - n.t)", "struct<seq:bigint,s:double>")
    return runs.select(*TRAJECTORY, F.inline(still)).withColumnRenamed("s", "stationary_sec")


def with_stationary(fixes: DataFrame, eps: float = K.MOVE_EPS_M) -> DataFrame:
    """Joins :func:`stationary_seconds` back on the fix's keys."""
    return fixes.join(stationary_seconds(fixes, eps).hint("merge"), [*TRAJECTORY, "seq"], "left")


def constrained_progress(fixes: DataFrame, max_speed: float = K.MAX_VEHICLE_SPEED_MPS) -> DataFrame:
    """``vehicle_id, trip_id, seq, dist_m``: raw projections made monotone and capped in speed.

    For shapes that cross themselves. A jump beyond the cap is believed if the next fix stays past the midpoint.
    """
    fixes = fixes.where("dist_m IS NOT NULL")
    ahead = fixes.select(*TRAJECTORY, "t", "seq", "dist_m", F.lead("dist_m").over(along()).alias("next"))
    runs = ahead.groupBy(*TRAJECTORY).agg(F.sort_array(F.collect_list(F.struct("t", "seq", F.col("dist_m").alias("d"), "next"))).alias("f"))
    limit = f"s.d + {max_speed} * greatest(x.t - s.t, 0D)"
    d = f"CASE WHEN s.d IS NULL THEN x.d WHEN x.d <= {limit} THEN greatest(x.d, s.d) WHEN x.next >= (s.d + x.d) / 2 THEN x.d ELSE greatest(least(x.d, {limit}), s.d) END"
    made = folded("f", "named_struct('t', cast(null AS double), 'd', cast(null AS double))", f"named_struct('t', x.t, 'd', {d})", "named_struct('seq', x.seq, 'd', n.d)", "struct<seq:bigint,d:double>")
    return runs.select(*TRAJECTORY, F.inline(made)).withColumnRenamed("d", "dist_m")


def nested_stops(stops: DataFrame) -> DataFrame:
    """``trip_id, stops``: a trip's stops as an array by distance, so that a fix meets them without a row explosion.

    ``left`` counts the trip's stops after it by sequence. The table outgrows the files that the planner judges it by,
    forty stops a trip from a few bytes of fixes, so joins with it are never broadcast.
    """
    one = F.struct(F.col("stop_sequence").alias("seq"), F.col("stop_dist_m").alias("d"), F.col("stop_id").alias("id"))
    trips = stops.groupBy("trip_id").agg(F.sort_array(F.collect_list(one)).alias("stops"))
    numbered = F.expr("sort_array(transform(stops, (s, i) -> named_struct('d', s.d, 'seq', s.seq, 'id', s.id, 'left', size(stops) - 1 - i)))")
    return trips.select("trip_id", numbered.alias("stops")).hint("merge")


def stop_crossings(fixes: DataFrame, stops: DataFrame) -> DataFrame:
    """``vehicle_id, trip_id, route_id, stop_id, stop_sequence, stop_dist_m, actual_arrival`` for each stop reached.

    A stop is reached at the first fix at or beyond it, so at the fix whose distance passes the running maximum of those
    before: each stop of a trajectory falls to one fix. The time is interpolated from the fix just before, and is the
    fix's own if there is none or it isn't behind.
    """
    return _crossings(fixes, stops).drop("stops_remaining")


def _crossings(fixes: DataFrame, stops: DataFrame) -> DataFrame:
    """:func:`stop_crossings` and how many stops of the trip remain after each."""
    w = along()
    f = fixes.where("dist_m IS NOT NULL").select(
        *TRAJECTORY, "route_id", "t", "dist_m", F.lag("t").over(w).alias("t0"), F.lag("dist_m").over(w).alias("d0"), F.coalesce(F.max("dist_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))).alias("reached")
    )
    met = f.where("dist_m > reached").join(nested_stops(stops), "trip_id").withColumn("s", F.explode(F.expr("filter(stops, s -> s.d > reached AND s.d <= dist_m)")))
    frac = (F.col("s.d") - F.col("d0")) / (F.col("dist_m") - F.col("d0"))
    arrival = F.when(F.col("dist_m") > F.col("d0"), F.col("t0") + frac * (F.col("t") - F.col("t0"))).otherwise(F.col("t"))
    return met.select(*TRAJECTORY, "route_id", F.col("s.id").alias("stop_id"), F.col("s.seq").alias("stop_sequence"), F.col("s.d").alias("stop_dist_m"), arrival.alias("actual_arrival"), F.col("s.left").alias("stops_remaining"))


def training_rows(fixes: DataFrame, stops: DataFrame, horizon: float = K.MAX_HORIZON_SEC, max_ahead: int = K.MAX_STOPS_AHEAD) -> DataFrame:
    """A row for each fix and each of its next stops that were reached, with the seconds until then.

    Stops in order of distance: those already passed in time are skipped, the first beyond the horizon ends the list
    (a later one within it doesn't count), and at most ``max_ahead`` stay. ``fixes`` has speed and stationary time.
    """
    stop = F.struct(F.col("stop_dist_m").alias("d"), F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("id"), F.col("actual_arrival").alias("at"), F.col("stops_remaining").alias("left"))
    arrived = _crossings(fixes, stops).groupBy(*TRAJECTORY).agg(F.array_sort(F.collect_list(stop)).alias("arrived"))
    near = F.expr("filter(arrived, s -> s.d > dist_m AND s.at >= t)")
    rows = fixes.join(arrived.hint("merge"), [*TRAJECTORY]).withColumn("near", near)
    far = F.expr(f"array_position(transform(near, s -> s.at - t > {horizon}), true)")
    rows = rows.withColumn("near", F.slice("near", F.lit(1), F.when(far > 0, F.least(far - 1, F.lit(max_ahead))).otherwise(F.lit(max_ahead)).cast("int")))
    rows = rows.select("*", F.posexplode("near").alias("k", "s")).drop("near", "arrived")
    each = {"stop_id": "s.id", "stop_sequence": "s.seq", "stop_dist_m": "s.d", "actual_arrival": "s.at", "stops_remaining": "s.left"}
    rows = rows.withColumns({c: F.col(of) for c, of in each.items()} | {"stops_ahead": F.col("k") + 1, "seconds_to_arrival": F.col("s.at") - F.col("t")}).drop("k", "s")
    made = ["stop_id", "stop_dist_m", "stops_ahead", "actual_arrival", "seconds_to_arrival", "stops_remaining"]
    return rows.where("stop_sequence IS NOT NULL").select("trip_id", "stop_sequence", *(c for c in fixes.columns if c != "trip_id"), *made)


def labels(crossings: DataFrame, schedule: DataFrame, feed_timezone: str = "UTC") -> DataFrame:
    """Crossings with their schedule: ``scheduled_arrival``, ``delay_sec``, local hour and UTC day of week (Monday 0).

    ``schedule(trip_id, stop_sequence, scheduled_arrival)`` in epoch seconds; joined by sequence.
    """
    at = F.timestamp_seconds("actual_arrival")
    both = crossings.join(schedule, ["trip_id", "stop_sequence"], "left")
    return both.select("*", (F.col("actual_arrival") - F.col("scheduled_arrival")).alias("delay_sec"), F.hour(F.from_utc_timestamp(at, feed_timezone)).alias("hour"), F.weekday(at).alias("day_of_week"))


def dwell_events(fixes: DataFrame, stops: DataFrame, moved: float = K.DWELL_MOVE_M, most: float = K.DWELL_MAX_SEC, radius: float = K.DWELL_STOP_RADIUS_M) -> DataFrame:
    """``vehicle_id, trip_id, route_id, dwell_sec``: rests near a stop that ended.

    Fixes that advance by less than ``moved`` form islands; an island of two or more that another follows is a rest of
    its span plus the gap to the next fix; its mean distance must lie within ``radius`` of a stop.
    """
    w = along()
    moving = F.coalesce((F.col("dist_m") - F.lag("dist_m").over(w) >= moved).cast("int"), F.lit(0))
    runs = fixes.select(*TRAJECTORY, "route_id", "t", "seq", "dist_m", moving.alias("moving")).withColumn("run", F.sum("moving").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_t", F.lead("t").over(w))
    size = Window.partitionBy(*TRAJECTORY)
    runs = runs.withColumn("n_fixes", F.count("*").over(size))
    rest = runs.groupBy(*TRAJECTORY, "route_id", "run").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.struct("t", "seq", "next_t")).alias("last"), F.avg("dist_m").alias("here"), F.first("n_fixes").alias("n_fixes"))
    rest = rest.where((F.col("n") >= 2) & (F.col("n_fixes") >= 3) & F.col("last.next_t").isNotNull()).withColumn("dwell_sec", F.col("t1") - F.col("t0") + (F.col("last.next_t") - F.col("t1")))
    rest = rest.where((F.col("dwell_sec") > 0) & (F.col("dwell_sec") <= most))
    near = F.expr("array_min(transform(stops, s -> abs(s.d - here)))")
    return rest.join(nested_stops(stops), "trip_id").where(near <= radius).select(*TRAJECTORY, "route_id", "dwell_sec")


def dwell_table(dwells: DataFrame, route_types: DataFrame, least: int = K.DWELL_MIN_EVENTS) -> DataFrame:
    """``route_type, n, dwell_sec``: the median rest by route type with enough events, and over all (type ``_global``)."""
    typed = dwells.join(route_types, "route_id", "left")
    found = quantiles(typed, [["route_type"], []], {"dwell_sec": F.col("dwell_sec")}, [0.5])
    kept = found.where((F.col("set") == 1) | (F.col("route_type").isNotNull() & (F.col("n_dwell_sec") >= least)))
    return kept.select(F.when(F.col("set") == 1, "_global").otherwise(F.col("route_type").cast("string")).alias("route_type"), F.col("n_dwell_sec").alias("n"), F.col("dwell_sec")[0].alias("dwell_sec"))


def off_route_signals(fixes: DataFrame, off: float = K.OFF_ROUTE_DIST_M, on: float = K.ON_ROUTE_DIST_M, wrong: float = K.BEARING_WRONG_DEG, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """Adds ``looks_off``: far off, or heading the wrong way, or moving away for three fixes. Needs ``off_m``, ``bearing_diff``."""
    w = along(*keys)
    d1, d2 = F.lag("off_m", 1).over(w), F.lag("off_m", 2).over(w)
    away = (F.col("off_m") > d1) & (d1 > d2) & (F.col("off_m") > on)
    heading = (F.col("bearing_diff") > wrong) & (F.col("off_m") > K.BEARING_MIN_DIST_M)
    return fixes.withColumn("looks_off", (F.col("off_m") > off) | F.coalesce(heading, F.lit(False)) | F.coalesce(away, F.lit(False)))


def off_route_status(fixes: DataFrame, consecutive_off: int = K.OFF_ROUTE_CONSEC, consecutive_on: int = K.ON_ROUTE_CONSEC, on: float = K.ON_ROUTE_DIST_M, keys: tuple[str, ...] = ("vehicle_id",), block_sec: float = 86_400.0) -> DataFrame:
    """``keys, seq, t, off_route``: on turns off after three fixes that look off, off turns on after three near ones.

    The signals are windows; the status is a fold over a status and one counter, a handful of states, so that a
    vehicle's history is folded in blocks of ``block_sec`` and never gathered whole. With ``trip_id`` among the keys
    each trip starts on route.
    """
    counts = max(consecutive_off, consecutive_on)
    signal = f"IF(s >= {counts}, x.near, x.looks_off)"
    full = f"s % {counts} + 1 >= IF(s >= {counts}, {consecutive_on}, {consecutive_off})"
    step = f"CASE WHEN NOT coalesce({signal}, false) THEN s - s % {counts} WHEN {full} THEN IF(s >= {counts}, 0, {counts}) ELSE s + 1 END"
    signals = off_route_signals(fixes, keys=keys).withColumn("near", F.col("off_m") <= on)
    out = f"named_struct('seq', x.seq, 't', x.t, 'off_route', n >= {counts})"
    return folded_in_blocks(signals, list(keys), F.floor(F.col("t") / block_sec), ["t", "seq"], ["looks_off", "near"], 2 * counts, step, out, "struct<seq:bigint,t:double,off_route:boolean>")


def off_route_episodes(statuses: DataFrame) -> DataFrame:
    """``vehicle_id, off_start, off_end, duration_min``: from the first fix off to the next one on, null if still open."""
    w = along("vehicle_id")
    changed = F.coalesce((F.col("off_route") != F.lag("off_route").over(w)), F.lit(True))
    turns = statuses.select("vehicle_id", "t", "seq", "off_route", changed.alias("changed")).where("changed")
    ends = turns.withColumn("off_end", F.lead("t").over(w)).where("off_route")
    return ends.select("vehicle_id", F.col("t").alias("off_start"), "off_end", ((F.col("off_end") - F.col("t")) / 60).alias("duration_min"))


def status_segments(statuses: DataFrame) -> DataFrame:
    """``vehicle_id, segment, off_route, first_t, last_t, n``: runs of equal status."""
    w = along("vehicle_id")
    changed = F.coalesce((F.col("off_route") != F.lag("off_route").over(w)).cast("int"), F.lit(1))
    runs = statuses.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("vehicle_id", "segment", "off_route").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


