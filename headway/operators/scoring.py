"""Scoring of served predictions against what happened: residuals, metrics by axis, coverage and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway import constants as K

KEY = ["vehicle_id", "trip_id", "stop_id", "stop_sequence"]


def lead_bucket(lead: Column) -> Column:
    out = F.when(lead < K.LEAD_EDGES_SEC[0], K.LEAD_LABELS[0])
    for edge, label in zip(K.LEAD_EDGES_SEC[1:], K.LEAD_LABELS[1:], strict=False):
        out = out.when(lead < edge, label)
    return out.otherwise(K.LEAD_LABELS[-1])


def first_actuals(actuals: DataFrame) -> DataFrame:
    """One arrival for each key: the earliest.

    Arrivals and predictions compress to a few bytes a row in the files that the planner judges them by, so joins
    with them here are never broadcast.
    """
    return actuals.groupBy(*KEY).agg(F.min("actual_arrival_ts").alias("actual_arrival_ts"), F.min("route_id").alias("route_id"))


def residuals(predictions: DataFrame, actuals: DataFrame, feed_timezone: str = "UTC", bounds: DataFrame | None = None) -> DataFrame:
    """Predictions joined to their arrivals, with errors, lead, hour and weekend; ``kept`` is false for what scoring drops.

    Dropped: predictions without lead, absolute errors over an hour, and with ``bounds(trip_id, start_ts, end_ts)``
    those more than two hours outside the trip's schedule. The flags stay, so that drops can be counted in one pass.
    """
    joined = predictions.join(first_actuals(actuals).drop("route_id").hint("merge"), KEY)
    error, lead = F.col("predicted_arrival") - F.col("actual_arrival_ts"), F.col("predicted_arrival") - F.col("feed_ts")
    at = F.timestamp_seconds("feed_ts")
    joined = joined.withColumns({"error_sec": error, "abs_error_sec": F.abs(error), "lead_sec": lead, "lead_bucket": lead_bucket(lead), "hour": F.hour(F.from_utc_timestamp(at, feed_timezone)), "is_weekend": F.weekday(at) >= 5})
    joined = joined.withColumns({"forward": F.col("lead_sec") > 0, "plausible": F.col("abs_error_sec") <= K.MAX_ABS_ERROR_SEC})
    on_schedule = F.lit(True)
    if bounds is not None:
        joined = joined.join(bounds, "trip_id", "left")
        on_schedule = F.coalesce(F.col("feed_ts").between(F.col("start_ts") - K.SCHEDULE_WINDOW_SEC, F.col("end_ts") + K.SCHEDULE_WINDOW_SEC), F.lit(True))
    joined = joined.withColumn("on_schedule", on_schedule)
    return joined.withColumn("kept", F.col("forward") & F.col("plausible") & F.col("on_schedule"))


def metrics() -> list[Column]:
    """Count, bias, mean, median and 90th percentile of the absolute error, exact."""
    return [
        F.count("*").alias("n"),
        F.avg("error_sec").alias("bias_sec"),
        F.avg("abs_error_sec").alias("mae_sec"),
        F.expr("percentile(abs_error_sec, 0.5)").alias("median_ae_sec"),
        F.expr("percentile(abs_error_sec, 0.9)").alias("p90_ae_sec"),
    ]


def score_by_axis(joined: DataFrame) -> DataFrame:
    """``axis, key, n, bias_sec, mae_sec, median_ae_sec, p90_ae_sec``: overall and along each axis, in one pass."""
    kept = joined.where("kept").withColumn("day", F.when(F.col("is_weekend"), "weekend").otherwise("weekday"))
    sets = [[], ["lead_bucket"], ["hour"], ["route_id"], ["stops_ahead"], ["day", "stops_ahead"]]
    cols = ["lead_bucket", "hour", "route_id", "stops_ahead", "day"]
    cells = kept.groupingSets(sets, *cols).agg(*metrics(), F.grouping_id().alias("g"))
    bit = {c: 1 << (len(cols) - 1 - i) for i, c in enumerate(cols)}
    all_off = sum(bit.values())
    axis, key = F.lit("overall"), F.lit("")
    for name, of in (("lead", ["lead_bucket"]), ("hour", ["hour"]), ("route", ["route_id"]), ("stops_ahead", ["stops_ahead"]), ("day_stops_ahead", ["day", "stops_ahead"])):
        here = F.col("g") == all_off - sum(bit[c] for c in of)
        axis = F.when(here, name).otherwise(axis)
        key = F.when(here, F.concat_ws(":", *(F.col(c).cast("string") for c in of))).otherwise(key)
    return cells.select(axis.alias("axis"), key.alias("key"), "n", "bias_sec", "mae_sec", "median_ae_sec", "p90_ae_sec")


def drop_counts(joined: DataFrame) -> DataFrame:
    """How much the filters of :func:`residuals` drop, as one row."""
    return joined.agg(
        F.count("*").alias("n_joined"),
        F.count_if("forward").alias("n_forward"),
        F.count_if(F.expr("forward AND NOT plausible")).alias("n_implausible"),
        F.count_if(F.expr("forward AND plausible AND NOT on_schedule")).alias("n_off_schedule"),
        F.count_if("kept").alias("n_kept"),
    )


def arriving_now(joined: DataFrame, within: int = K.ARRIVING_NOW_SEC) -> DataFrame:
    """Of the predictions due within a minute, the share that came within a minute of it."""
    due = joined.where(F.col("kept") & (F.col("lead_sec") <= within))
    return due.agg(F.count("*").alias("n"), F.avg((F.col("abs_error_sec") <= within).cast("double")).alias("calibrated_frac"))


def strict_coverage(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """``n_actual, n_covered, coverage_frac`` over distinct keys."""
    keys = actuals.select(*KEY).distinct().join(predictions.select(*KEY).distinct().withColumn("covered", F.lit(1)).hint("merge"), KEY, "left")
    return keys.agg(F.count("*").alias("n_actual"), F.count("covered").alias("n_covered"), (F.count("covered") / F.count("*")).alias("coverage_frac"))


def physical_coverage(predictions: DataFrame, actuals: DataFrame, within: int = K.MAX_ABS_ERROR_SEC) -> DataFrame:
    """Coverage where any prediction of the vehicle at that stop within an hour counts, whatever trip it named.

    Existence within a tolerance needs no nearest match: predictions are cut into buckets of the tolerance, and an
    arrival looks into its own and the two beside, so that the semi-join has equal keys only and doesn't compare all
    of a vehicle's day.
    """
    a = first_actuals(actuals).withColumn("b", F.explode(F.expr(f"transform(array(-1, 0, 1), x -> x + actual_arrival_ts div {within})")))
    p = predictions.select(F.col("vehicle_id").alias("v"), F.col("stop_id").alias("s"), "predicted_arrival", F.expr(f"predicted_arrival div {within}").alias("pb")).distinct().hint("merge")
    near = (F.col("vehicle_id") == F.col("v")) & (F.col("stop_id") == F.col("s")) & (F.col("b") == F.col("pb")) & (F.abs(F.col("predicted_arrival") - F.col("actual_arrival_ts")) <= within)
    covered = a.join(p, near, "left_semi").select(*KEY).distinct().withColumn("covered", F.lit(1)).hint("merge")
    keys = first_actuals(actuals).join(covered, KEY, "left")
    return keys.agg(F.count("*").alias("n_actual"), F.count("covered").alias("n_covered"), (F.count("covered") / F.count("*")).alias("coverage_frac"))


def nearest_prediction(predictions: DataFrame, actuals: DataFrame, within: int = K.MAX_ABS_ERROR_SEC) -> DataFrame:
    """The nearest prediction in time for each arrival of the same vehicle and stop, null beyond the tolerance; ties go backward."""
    a = first_actuals(actuals).select(*KEY, F.col("actual_arrival_ts").alias("ts"), F.lit(1).alias("is_actual"))
    p = predictions.select("vehicle_id", F.lit(None).cast("string").alias("trip_id"), "stop_id", F.lit(None).cast("int").alias("stop_sequence"), F.col("predicted_arrival").alias("ts"), F.lit(0).alias("is_actual"))
    w = Window.partitionBy("vehicle_id", "stop_id")
    given = F.when(F.col("is_actual") == 0, F.col("ts"))
    both = a.unionByName(p).withColumns(
        {
            "before": F.last(given, True).over(w.orderBy("ts", "is_actual").rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(given, True).over(w.orderBy("ts", F.col("is_actual").desc()).rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    nearest = F.when(F.col("after").isNull() | (F.col("ts") - F.col("before") <= F.col("after") - F.col("ts")), F.col("before")).otherwise(F.col("after"))
    out = both.where("is_actual = 1").withColumn("nearest", nearest)
    return out.select(*KEY, F.col("ts").alias("actual_arrival_ts"), F.when(F.abs(F.col("nearest") - F.col("ts")) <= within, F.col("nearest")).alias("predicted_arrival"))


def coverage_gaps(predictions: DataFrame, actuals: DataFrame, feed_timezone: str = "UTC") -> DataFrame:
    """Arrivals with ``cause``: covered, vehicle_absent, trip_mismatch or stop_missing, and the local hour."""
    p1 = predictions.select("vehicle_id").distinct().withColumn("has_vehicle", F.lit(True)).hint("merge")
    p2 = predictions.select("vehicle_id", "trip_id").distinct().withColumn("has_trip", F.lit(True)).hint("merge")
    p3 = predictions.select(*KEY).distinct().withColumn("has_stop", F.lit(True)).hint("merge")
    tagged = actuals.join(p3, KEY, "left").join(p2, ["vehicle_id", "trip_id"], "left").join(p1, "vehicle_id", "left")
    cause = F.when(F.col("has_stop"), "covered").when(F.col("has_vehicle").isNull(), "vehicle_absent").when(F.col("has_trip").isNull(), "trip_mismatch").otherwise("stop_missing")
    return tagged.select(*KEY, "route_id", "actual_arrival_ts", cause.alias("cause"), F.hour(F.from_utc_timestamp(F.timestamp_seconds("actual_arrival_ts"), feed_timezone)).alias("hour"))


def gap_counts(gaps: DataFrame, by: str | None = None, top: int | None = None) -> DataFrame:
    """Arrivals, uncovered ones and their causes, over all or by a column; the ``top`` with most uncovered."""
    each = [F.count_if(F.col("cause") == c).alias(c) for c in ("vehicle_absent", "trip_mismatch", "stop_missing")]
    cells = (gaps.groupBy(by) if by else gaps.groupBy()).agg(F.count("*").alias("n_actual"), F.count_if(F.col("cause") != "covered").alias("n_uncovered"), *each)
    cells = cells.withColumn("coverage_frac", F.try_divide(F.col("n_actual") - F.col("n_uncovered"), F.col("n_actual")))
    return cells.orderBy(F.desc("n_uncovered"), by).limit(top) if by and top else cells


def worst_routes(joined: DataFrame, top: int = 8, least: int = 50) -> DataFrame:
    """The routes of largest mean error with enough rows, each with its metrics by stops ahead."""
    kept = joined.where("kept")
    worst = kept.groupBy("route_id").agg(F.count("*").alias("route_n"), F.avg("abs_error_sec").alias("route_mae_sec")).where(F.col("route_n") >= least).orderBy(F.desc("route_mae_sec"), "route_id").limit(top)
    return kept.join(F.broadcast(worst), "route_id").groupBy("route_id", "route_n", "route_mae_sec", "stops_ahead").agg(*metrics())


def worst_predictions(joined: DataFrame, top: int = 5) -> DataFrame:
    cols = ["route_id", "vehicle_id", "stop_id", "stops_ahead", "feed_ts", "lead_sec", "error_sec", "abs_error_sec"]
    return joined.where("kept").select(*cols).orderBy(F.desc("abs_error_sec"), "vehicle_id", "stop_id", "feed_ts").limit(top)
