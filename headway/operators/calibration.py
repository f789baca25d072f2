"""Feedback from daily quality metrics: pooled uncertainty and bias, accumulation, overlays, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(reports: DataFrame, days: int, since: str | None = None) -> DataFrame:
    """Reports of the latest ``days`` dates from ``since`` on; the status is looked at only then, as days are taken first."""
    if since is not None:
        reports = reports.where(F.col("date") >= since)
    latest = reports.select("date").distinct().orderBy(F.desc("date")).limit(days)
    return reports.join(F.broadcast(latest), "date", "left_semi").where("status = 'ok'")


def pooled_mae(reports: DataFrame, least: int = 200) -> DataFrame:
    """``stops_ahead, n, mae_sec`` over all days by weight, never less than at a shorter horizon."""
    cells = reports.where("n > 0").groupBy("stops_ahead").agg(F.sum("n").alias("n"), (F.sum(F.col("mae_sec") * F.col("n")) / F.sum("n")).alias("pooled")).where(F.col("n") >= least)
    return cells.select("stops_ahead", "n", F.max("pooled").over(Window.orderBy("stops_ahead").rowsBetween(Window.unboundedPreceding, 0)).alias("mae_sec"))


def pooled_bias(reports: DataFrame, by: tuple[str, ...] = (), least: int = 200) -> DataFrame:
    """``stops_ahead, n, bias_sec`` over all days by weight, and by more columns such as the kind of day."""
    return reports.where("n > 0").groupBy(*by, "stops_ahead").agg(F.sum("n").alias("n"), (F.sum(F.col("bias_sec") * F.col("n")) / F.sum("n")).alias("bias_sec")).where(F.col("n") >= least)


def live_uncertainty(reports: DataFrame, days: int = 7, since: str | None = None) -> DataFrame:
    """Pooled error since a date, and over the whole window where that leaves nothing: decided by one row on the driver."""
    narrow = pooled_mae(recent(reports, days, since))
    return narrow if since is None or not narrow.isEmpty() else pooled_mae(recent(reports, days))


def live_bias(reports: DataFrame, days: int = 7, since: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pooled bias since a date; nothing if nothing was measured, so that no day is absorbed twice."""
    return pooled_bias(recent(reports, days, since), by)


def accumulate_bias(live: DataFrame, residual: DataFrame, gain: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """``live + gain * residual``, rounded half to even, at the horizons measured; what was never live counts as 0."""
    keys = [*by, "stops_ahead"]
    both = residual.select(*keys, F.col("bias_sec").alias("r")).join(live.select(*keys, F.col("bias_sec").alias("l")), keys, "left")
    return both.select(*keys, F.bround(F.coalesce("l", F.lit(0.0)) + gain * F.col("r")).cast("long").alias("bias_sec"))


def merge_bias(flat: DataFrame, live: DataFrame, residual: DataFrame, gain: float = 0.5, kinds: tuple[str, ...] = ("weekday", "weekend")) -> DataFrame:
    """By kind of day: the accumulated correction where measured, else what is live, else the flat table.

    ``flat(stops_ahead, bias_sec)``; ``live`` and ``residual`` have ``day`` too, one of ``kinds``. Days are those of live and residual.
    """
    keys = ["day", "stops_ahead"]
    days = live.select("day").unionByName(residual.select("day")).distinct()
    of_all = flat.select(F.explode(F.array(*map(F.lit, kinds))).alias("day"), "stops_ahead", F.col("bias_sec").cast("long").alias("f"))
    base = of_all.join(days, "day", "left_semi")
    moved = accumulate_bias(live, residual, gain, ("day",)).withColumnRenamed("bias_sec", "m")
    out = base.join(live.select(*keys, F.col("bias_sec").cast("long").alias("l")), keys, "full").join(moved, keys, "full")
    return out.select(*keys, F.coalesce("m", "l", "f").alias("bias_sec"))


def route_digest(daily: DataFrame, least: int = 30) -> DataFrame:
    """``route_id, date, n, mae_sec, delta_sec, thin``: the change from the calendar day before, null without one."""
    w = Window.partitionBy("route_id").orderBy("date")
    before, when = F.lag("mae_sec").over(w), F.lag("date").over(w)
    delta = F.when(F.date_add(when, 1) == F.col("date"), F.col("mae_sec") - before)
    return daily.select("route_id", "date", "n", "mae_sec", delta.alias("delta_sec"), (F.col("n") < least).alias("thin"))
