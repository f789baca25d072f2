"""What the live feed serves for a vehicle: features of the stops ahead, terminus departures, delay, dwell and bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway import constants as K
from headway.functions.serving import at_first_stop, horizon_value
from headway.operators.features import FEATURES, apply_priors, calendar_features, with_codes
from headway.operators.schedule import seconds_at


def upcoming(vehicles: DataFrame, stops: DataFrame, max_ahead: int = K.MAX_STOPS_AHEAD) -> DataFrame:
    """Each vehicle with the next stops strictly ahead of it: ``stop_id, stop_sequence, stop_dist_m, cum_sec, stops_ahead, stops_remaining``.

    A trip's stops are an array, so that a vehicle meets them once and only the rows served are made.
    """
    nested = stops.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "stop_dist_m", "cum_sec"))).alias("s"))
    met = vehicles.join(nested, "trip_id")
    places = F.transform("s", lambda x, i: F.struct(x.alias("x"), (F.size("s") - 1 - i).alias("left")))
    ahead = F.slice(F.filter(places, lambda y: y["x"]["stop_dist_m"] > F.col("dist_m")), 1, max_ahead)
    rows = met.select(*vehicles.columns, F.posexplode(ahead).alias("i", "y"))
    return rows.select(*vehicles.columns, "y.x.stop_id", "y.x.stop_sequence", "y.x.stop_dist_m", "y.x.cum_sec", (F.col("i") + 1).alias("stops_ahead"), F.col("y.left").alias("stops_remaining"))


def serving_features(vehicles: DataFrame, stops: DataFrame, lengths: DataFrame) -> DataFrame:
    """The model's inputs for each stop ahead, but for the priors, with the schedule's own ``sched_remaining_sec``.

    ``vehicles(trip_id, dist_m, service_date, ..)`` keep their columns; vehicles of unknown trips go.
    """
    profile = stops.select("trip_id", F.col("stop_dist_m").alias("dist_m"), "cum_sec")
    rows = calendar_features(upcoming(seconds_at(vehicles, profile), stops)).join(lengths, "trip_id")
    remaining = F.col("stop_dist_m") - F.col("dist_m")
    return rows.withColumns(
        {
            "remaining_dist_m": remaining,
            "trip_progress_frac": F.col("stop_dist_m") / F.greatest(F.col("length_m"), F.lit(1.0)),
            "dist_per_stop_m": remaining / F.greatest(F.col("stops_ahead"), F.lit(1)),
            "sched_remaining_sec": F.greatest(F.col("cum_sec") - F.coalesce("sched_sec", F.lit(0.0)), F.lit(0.0)),
        }
    ).drop("length_m", "sched_sec")


def served_vector(vehicles: DataFrame, stops: DataFrame, lengths: DataFrame, priors: DataFrame, codes: DataFrame) -> DataFrame:
    """The columns of ``vehicles``, ``stop_id, stop_dist_m``, ``route_code`` and FEATURES: a served row has what a training row of the same fix and stop has.

    ``vehicles(trip_id, route_id, dist_m, service_date, hour, ..)``; a speed or rest that they lack, or that is null, is -1
    and 0, what a vehicle seen for the first time has in training.
    """
    for name, unknown in (("progress_speed_mps", -1.0), ("stationary_sec", 0.0)):
        vehicles = vehicles.withColumn(name, F.coalesce(F.col(name), F.lit(unknown)) if name in vehicles.columns else F.lit(unknown))
    rows = with_codes(apply_priors(serving_features(vehicles, stops, lengths), priors), codes)
    return rows.select(*dict.fromkeys([*vehicles.columns, "stop_id", "stop_dist_m", "route_code", *FEATURES]))


def terminus_predictions(ahead: DataFrame) -> DataFrame:
    """Rows of :func:`upcoming` with ``seconds``: for vehicles that wait at their first stop, the timetable's departure and time of travel.

    ``until_departure`` is that of the clock functions, null where the timetable isn't believed; ``first_stop_m, off_m`` say where the vehicle waits.
    """
    waits = at_first_stop(F.col("dist_m"), F.col("off_m"), F.col("first_stop_m")) & F.col("until_departure").isNotNull()
    return ahead.where(waits & F.col("cum_sec").isNotNull()).withColumn("seconds", F.col("until_departure") + F.col("cum_sec").cast("double"))


def publishes_delay(route_type: Column) -> Column:
    """Only rail- and wire-bound vehicles keep their timetable; an unknown kind doesn't."""
    return F.coalesce(route_type.isin(K.TRAM, K.TROLLEYBUS), F.lit(False))


def trip_delay(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, delay_sec``: at the nearest predicted stop, whole seconds late, cut towards zero; null where it isn't published.

    ``predictions(keys, t, stops_ahead, seconds, scheduled, route_type)`` with epoch seconds.
    """
    late = (F.col("t") + F.col("seconds") - F.col("scheduled")).cast("int")
    nearest = predictions.groupBy(*keys).agg(F.min_by(F.struct(late.alias("late"), "route_type"), "stops_ahead").alias("p"))
    return nearest.select(*keys, F.when(publishes_delay(F.col("p.route_type")), F.col("p.late")).alias("delay_sec"))


def with_dwell(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``dwell_sec`` of the route's kind by ``table(route_type, dwell_sec)``, whose ``_global`` row is for other kinds; without any, DEFAULT_DWELL_SEC."""
    known = table.select(F.col("route_type").alias("kind"), F.col("dwell_sec").alias("own"))
    whole = table.where("route_type = '_global'").agg(F.max("dwell_sec").alias("whole"))
    met = rows.join(known, F.col("route_type").cast("string") == F.col("kind"), "left").join(F.broadcast(whole), how="left")
    return met.withColumn("dwell_sec", F.coalesce("own", "whole", F.lit(K.DEFAULT_DWELL_SEC)).cast("int")).drop("kind", "own", "whole")


def with_bias(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``bias_sec`` at ``stops_ahead``: by the table of the kind of day, else the ``flat`` one, else 0.

    ``tables(kind, stops_ahead, bias_sec)`` with kinds ``weekday``, ``weekend`` and ``flat``. A table's value at its longest
    horizon holds beyond it and in its gaps; below its shortest there is no correction.
    """
    maps = tables.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("stops_ahead", "bias_sec"))).alias("m"))
    chosen = maps.groupBy().agg(*(F.first(F.when(F.col("kind") == k, F.col("m")), ignorenulls=True).alias(k) for k in ("weekday", "weekend", "flat")))
    kind = F.coalesce(F.when(F.weekday("service_date") >= 5, F.col("weekend")).otherwise(F.col("weekday")), F.col("flat"))
    return rows.join(F.broadcast(chosen), how="left").withColumn("bias_sec", F.coalesce(horizon_value(kind, F.col("stops_ahead")), F.lit(0))).drop("weekday", "weekend", "flat")


def nearest_shape(fixes: DataFrame, candidates: DataFrame, keys: list[str], beyond: float = K.MAX_DIST_M) -> DataFrame:
    """``keys, off_m``: how far a fix is from its matched trip, or where that is farther than ``beyond`` or there is none,
    from the nearest of that trip and the candidate shapes.

    ``fixes(keys, matched_off_m)``, ``candidates(keys, off_m)``. Each fix stays; without trip and candidates ``off_m`` is null.
    """
    least = candidates.groupBy(*keys).agg(F.min("off_m").alias("least"))
    own = F.col("matched_off_m")
    return fixes.join(least, keys, "left").select(*keys, F.when(own <= beyond, own).otherwise(F.least(own, F.col("least"))).alias("off_m"))
