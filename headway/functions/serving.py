"""Per-row rules of the served feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def congestion_level(speed: Column, usual: Column) -> Column:
    """By the speed's share of the usual one: running smoothly, stop and go, congestion, severe; null if unknown."""
    share = speed / usual
    return F.when((speed > 0) & (usual > 0), F.when(share >= 0.7, "RUNNING_SMOOTHLY").when(share >= 0.4, "STOP_AND_GO").when(share >= 0.2, "CONGESTION").otherwise("SEVERE_CONGESTION"))


def stop_status(remaining_m: Column) -> Column:
    return F.when(remaining_m <= 25, "STOPPED_AT").when(remaining_m <= 150, "INCOMING_AT").otherwise("IN_TRANSIT_TO")


def isotonic(values: Column) -> Column:
    """The least-squares non-decreasing fit of an array: for each place, the largest of the least means.

    Fit at i is the maximum over a <= i of the minimum over b >= i of the mean of places a to b; arrays are as long as
    a feed's stops ahead.
    """
    sums = F.aggregate(values, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    n = F.size(values)

    def fit(sums):
        def at(i):
            def least(a):
                return F.array_min(F.transform(F.sequence(i, n), lambda b: (F.element_at(sums, b + 1) - F.element_at(sums, a)) / (b - a + 1)))

            return F.array_max(F.transform(F.sequence(F.lit(1), i), least))

        return F.transform(F.sequence(F.lit(1), n), at)

    # bound by a lambda, so that the sums are made once an array and not for each mean
    return F.when(n > 0, F.element_at(F.transform(F.array(sums), fit), 1)).otherwise(values)


def arrival_times(now: Column, seconds: Column) -> Column:
    """Served arrivals: whole seconds, never before the one before, never before the second after now."""
    times = F.aggregate(
        seconds, F.array().cast("array<bigint>"), lambda acc, s: F.concat(acc, F.array(F.greatest((now + s).cast("bigint"), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-(2**62)).cast("bigint")))))
    )
    return F.transform(times, lambda t: F.greatest(t, (now + 1).cast("bigint")))


def horizon_value(table: Column, horizon: Column) -> Column:
    """A table's value at a horizon; where it has none, that of its longest horizon; null below its shortest."""
    keys = F.map_keys(table)
    return F.coalesce(F.try_element_at(table, horizon), F.when(horizon >= F.array_min(keys), F.try_element_at(table, F.array_max(keys))))


def at_first_stop(dist_m: Column, off_m: Column, first_stop_m: Column) -> Column:
    return F.coalesce((off_m <= 150) & (F.abs(dist_m - first_stop_m) <= 50), F.lit(False))


def prediction_source(speed: Column, dist_m: Column, off_m: Column, first_stop_m: Column, until_departure: Column) -> Column:
    """``withheld`` for a vehicle at rest before its first stop, ``schedule`` for one there that leaves by timetable,
    ``idle`` for the model's word on one that doesn't, ``model`` else."""
    resting = (speed <= 0) & (dist_m < 20)
    there = at_first_stop(dist_m, off_m, first_stop_m)
    return F.when(resting & ~there, "withheld").when(resting & until_departure.isNotNull(), "schedule").when(resting, "idle").otherwise("model")


def band_seconds(source: Column, by_horizon: Column) -> Column:
    """The uncertainty served: 150 s on schedule, 400 s for the model at rest, else by horizon."""
    return F.when(source == "schedule", 150).when(source == "idle", 400).otherwise(by_horizon)


def usable_fix(lat: Column, lon: Column, route_id: Column) -> Column:
    """Live fixes need a place (zero counts as none) and a route."""
    return F.coalesce((lat != 0) & (lon != 0) & (route_id != ""), F.lit(False))


def health_verdict(age_sec: Column, arrivals: Column, hour_utc: Column, vehicles_in: Column, vehicles_stale: Column) -> Column:
    """none, stale, degraded in working hours (upstream, if all its vehicles were stale), aging or ok."""
    empty = hour_utc.between(5, 17) & (arrivals == 0)
    upstream = F.coalesce((vehicles_in > 0) & (vehicles_stale >= vehicles_in), F.lit(False))
    return F.when(age_sec.isNull(), "none").when(age_sec > 180, "stale").when(empty & upstream, "degraded_upstream").when(empty, "degraded").when(age_sec > 60, "aging").otherwise("ok")
