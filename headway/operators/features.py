"""Features, priors, splits and sampling for arrival-time models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway import constants as K
from headway.operators.quantiles import quantiles
from headway.operators.schedule import seconds_at

#: Order of the model's inputs; imported models count on it.
FEATURES = (
    "route_id", "stop_sequence", "stops_ahead", "hour", "day_of_week", "month", "is_weekend", "is_holiday", "remaining_dist_m", "progress_speed_mps", "stops_remaining", "trip_progress_frac",
    "dist_per_stop_m", "speed_eta_warm", "hist_speed_mps", "hist_travel_time_est", "stationary_sec",
)


def is_holiday(day: Column) -> Column:
    return (F.month(day) * 100 + F.dayofmonth(day)).isin(*K.HOLIDAYS_MMDD).cast("int")


def sample_weight(hour: Column) -> Column:
    """Evening rows count double, the afternoon peak half as much again."""
    return F.when((hour >= 18) | (hour <= 3), 2.0).when(hour.between(14, 16), 1.5).otherwise(1.0)


def calendar_features(rows: DataFrame, day: str = "service_date") -> DataFrame:
    dow = F.weekday(day)
    return rows.withColumns({"day_of_week": dow, "is_weekend": (dow >= 5).cast("int"), "month": F.month(day), "is_holiday": is_holiday(F.col(day))})


def progress_features(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds remaining distance, progress along ``lengths(trip_id, length_m)``, and distance a stop; unknown trips go."""
    rows = rows.join(lengths, "trip_id")
    remaining = F.greatest(F.lit(0.0), F.col("stop_dist_m") - F.col("dist_m"))
    return rows.withColumns({"remaining_dist_m": remaining, "trip_progress_frac": F.col("stop_dist_m") / F.greatest(F.col("length_m"), F.lit(1.0)), "dist_per_stop_m": remaining / F.greatest(F.col("stops_ahead"), F.lit(1))}).drop("length_m")


def scheduled_remaining(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds ``sched_remaining_sec``: the schedule's seconds from the fix's place to the stop's, never negative.

    ``rows(trip_id, dist_m, stop_dist_m)``, ``profile(trip_id, dist_m, cum_sec)``, as the served features have it; null
    where a trip's schedule has fewer than two known places.
    """
    here = seconds_at(rows, profile, "dist_m").withColumnRenamed("sched_sec", "sched_here")
    left = F.col("sched_sec") - F.col("sched_here")
    return seconds_at(here, profile, "stop_dist_m").withColumn("sched_remaining_sec", F.when(left.isNotNull(), F.greatest(left, F.lit(0.0)))).drop("sched_sec", "sched_here")


def route_hour_priors(rows: DataFrame) -> DataFrame:
    """``route_id, hour, speed, sec_per_stop``: exact medians by route and hour; the global row has nulls for keys.

    Speeds count where positive. Cells without any get the global median, and the fallbacks where that is null too.
    """
    speed = F.when(F.col("progress_speed_mps") > 0, F.col("progress_speed_mps"))
    found = quantiles(rows, [["route_id", "hour"], []], {"speed": speed, "sec_per_stop": F.col("seconds_to_arrival") / F.col("stops_ahead")}, [0.5])
    cells = found.select("route_id", "hour", F.col("speed")[0].alias("speed"), F.col("sec_per_stop")[0].alias("sec_per_stop"), F.col("set").alias("all"))
    whole = cells.where("all = 1").select(F.coalesce("speed", F.lit(K.FALLBACK_SPEED_MPS)).alias("g_speed"), F.coalesce("sec_per_stop", F.lit(K.FALLBACK_SEC_PER_STOP)).alias("g_per_stop"))
    return cells.join(F.broadcast(whole)).select("route_id", "hour", F.coalesce("speed", "g_speed").alias("speed"), F.coalesce("sec_per_stop", "g_per_stop").alias("sec_per_stop"))


def apply_priors(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds the effective speed, the ETA at that speed, and the time that so many stops usually take.

    Priors are one row a route and hour, left to the planner to broadcast; routes without get the global row's.
    """
    whole = priors.where("route_id IS NULL AND hour IS NULL").select(F.col("speed").alias("g_speed"), F.col("sec_per_stop").alias("g_per_stop"))
    rows = rows.join(priors.where("route_id IS NOT NULL"), ["route_id", "hour"], "left").join(F.broadcast(whole), how="left")
    speed = F.coalesce("speed", "g_speed", F.lit(K.FALLBACK_SPEED_MPS))
    effective = F.when(F.col("progress_speed_mps") > 0, F.col("progress_speed_mps")).otherwise(speed)
    remaining = F.greatest(F.lit(0.0), F.col("stop_dist_m") - F.col("dist_m"))
    out = rows.withColumns({"hist_speed_mps": speed, "effective_speed_mps": effective, "speed_eta_warm": remaining / F.greatest(effective, F.lit(0.1)), "hist_travel_time_est": F.col("stops_ahead") * F.coalesce("sec_per_stop", "g_per_stop", F.lit(K.FALLBACK_SEC_PER_STOP))})
    return out.drop("speed", "sec_per_stop", "g_speed", "g_per_stop")


def sane(rows: DataFrame, needed: tuple[str, ...] = ("seconds_to_arrival", "dist_m"), excluded: tuple[str, ...] = K.EXCLUDED_ROUTES) -> DataFrame:
    """Rows without nulls in the needed columns, a target within the horizon, and no excluded route."""
    return rows.dropna(subset=list(needed)).where(F.col("seconds_to_arrival").between(0, K.MAX_HORIZON_SEC) & ~F.col("route_id").isin(*excluded))


def bucket(share: float, *keys: str) -> Column:
    """Whether the hash of the keys falls into this share: a sample that every run, and every engine, draws alike."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000)


def snapshot_sample(rows: DataFrame, share: float, snapshot: str = "feed_ts") -> DataFrame:
    """All rows of that share of the snapshots, chosen by hash: rows of one snapshot stay together."""
    return rows.where(bucket(share, snapshot))


def capped_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows chosen by hash of the keys, all where there are fewer; a Parquet table is counted by its metadata."""
    n = rows.count()
    return rows if n <= most else rows.where(bucket(most / n, *keys))


def time_split(rows: DataFrame, share: float = 0.8, day: str = "service_date", keys: tuple[str, ...] = ("vehicle_id", "trip_id", "seq", "stop_sequence")) -> DataFrame:
    """Adds ``is_train``: dates before the cutoff, which leaves that share of the distinct dates.

    Of routes first seen from the cutoff on, this share of the rows moves to training, chosen by hash of the keys.
    """
    days = rows.select(day).distinct()
    nth = Window.orderBy(day)
    cutoff = days.withColumns({"k": F.row_number().over(nth) - 1, "n": F.count("*").over(Window.partitionBy())}).where(F.col("k") == F.floor(F.col("n") * share)).select(F.col(day).alias("cutoff"))
    marked = rows.join(F.broadcast(cutoff), how="left").withColumn("old", F.coalesce(F.col(day) < F.col("cutoff"), F.lit(True)))
    known = marked.where("old").select("route_id").distinct().withColumn("known", F.lit(True))
    marked = marked.join(known, "route_id", "left")
    return marked.withColumn("is_train", F.col("old") | (F.col("known").isNull() & bucket(share, *keys))).drop("old", "known", "cutoff")


def ordinal_codes(rows: DataFrame, column: str = "route_id") -> DataFrame:
    """``route_id, route_code``: codes in the order of the values."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("route_code", F.row_number().over(Window.orderBy(column)) - 1)


def with_codes(rows: DataFrame, codes: DataFrame, column: str = "route_id") -> DataFrame:
    """Adds ``route_code``, -1 for unknown values."""
    return rows.join(codes, column, "left").withColumn("route_code", F.coalesce("route_code", F.lit(-1)))


def uncertainty_by_horizon(rows: DataFrame, predicted: str, least: int = 200) -> DataFrame:
    """``stops_ahead, n, mae_sec`` where there are enough rows."""
    return rows.groupBy("stops_ahead").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(predicted) - F.col("seconds_to_arrival"))).alias("mae_sec")).where(F.col("n") >= least)
