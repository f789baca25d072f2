"""The segment model: median times between neighbouring stops, summed ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway import constants as K
from headway.operators.quantiles import quantiles

SNAPSHOT = ("vehicle_id", "trip_id", "seq")


def _ahead():
    return Window.partitionBy(*SNAPSHOT).orderBy("stops_ahead")


def link_observations(rows: DataFrame) -> DataFrame:
    """``route_id, stop_id, hour, link_sec, link_m`` from neighbouring rows of a snapshot, under half an hour."""
    w = _ahead()
    diff = lambda c: F.col(c) - F.lag(c).over(w)
    links = rows.select("route_id", "stop_id", "hour", diff("seconds_to_arrival").alias("link_sec"), diff("stop_dist_m").alias("link_m"), diff("stops_ahead").alias("d"))
    return links.where((F.col("d") == 1) & (F.col("link_sec") > 0) & (F.col("link_sec") < 1800)).drop("d")


def link_tables(links: DataFrame) -> DataFrame:
    """``level, route_id, stop_id, hour, n, link_sec, link_m, link_mps``: exact medians on five sets of keys."""
    sets = [["route_id", "stop_id", "hour"], ["route_id", "stop_id"], ["stop_id"], ["route_id", "hour"], []]
    found = quantiles(links, sets, {"link_sec": F.col("link_sec"), "link_m": F.col("link_m"), "link_mps": F.col("link_m") / F.col("link_sec")}, [0.5])
    level = F.element_at(F.array(*map(F.lit, ("rsh", "rs", "s", "rh", "all"))), F.col("set") + 1)
    return found.select(level.alias("level"), "route_id", "stop_id", "hour", F.col("n_link_sec").alias("n"), *(F.col(c)[0].alias(c) for c in ("link_sec", "link_m", "link_mps")))


def with_link(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``link``, ``seg_m`` and ``usual_mps``: the median from the most specific keys that have one."""
    at = lambda level, keys, *cols: tables.where(F.col("level") == level).select(*keys, *(F.col(a).alias(b) for a, b in cols))
    out = rows.join(at("rsh", ["route_id", "stop_id", "hour"], ("link_sec", "l1")), ["route_id", "stop_id", "hour"], "left")
    out = out.join(at("rs", ["route_id", "stop_id"], ("link_sec", "l2"), ("link_m", "m2")), ["route_id", "stop_id"], "left")
    out = out.join(at("s", ["stop_id"], ("link_sec", "l3")), ["stop_id"], "left")
    out = out.join(at("rh", ["route_id", "hour"], ("link_sec", "l4"), ("link_mps", "v4")), ["route_id", "hour"], "left")
    out = out.join(F.broadcast(at("all", [], ("link_sec", "l5"), ("link_m", "m5"), ("link_mps", "v5"))), how="left")
    return out.withColumns({"link": F.coalesce("l1", "l2", "l3", "l4", "l5"), "seg_m": F.when(F.col("m2") > 1, F.col("m2")).otherwise(F.col("m5")), "usual_mps": F.coalesce("v4", "v5")}).drop("l1", "l2", "l3", "l4", "l5", "m2", "m5", "v4", "v5")


def predict_segments(rows: DataFrame, tables: DataFrame, congestion: bool = False) -> DataFrame:
    """Adds ``segment_eta``: the rest of the segment under way and the links of the stops after it.

    With ``congestion``, links stretch by how much slower than usual the vehicle is, within 0.7 to 2.
    """
    rows = with_link(rows, tables)
    if congestion:
        ratio = F.when(F.col("progress_speed_mps") > 0.3, F.col("usual_mps") / F.col("progress_speed_mps")).otherwise(1.0)
        rows = rows.withColumn("link", F.col("link") * F.greatest(F.lit(0.7), F.least(F.lit(2.0), ratio)))
    w = _ahead()
    first = lambda c: F.first(c).over(w)
    share = (first("stop_dist_m") - F.col("dist_m")) / F.greatest(first("seg_m"), F.lit(1.0))
    partial = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * first("link")
    ahead = F.sum("link").over(w.rowsBetween(Window.unboundedPreceding, 0)) - first("link")
    return rows.withColumn("segment_eta", partial + ahead).drop("link", "seg_m", "usual_mps")


def calibrated(rows: DataFrame, corrections: DataFrame, predicted: str = "segment_eta") -> DataFrame:
    """Adds ``calibrated_eta``: less the median error at the horizon, not below 0. ``corrections(stops_ahead, median_error)``."""
    return rows.join(corrections, "stops_ahead", "left").withColumn("calibrated_eta", F.greatest(F.lit(0.0), F.col(predicted) - F.coalesce("median_error", F.lit(0.0)))).drop("median_error")


def horizon_corrections(rows: DataFrame, predicted: str = "segment_eta") -> DataFrame:
    """``stops_ahead, median_error``: exact medians, of which no task holds a horizon's errors."""
    found = quantiles(rows, [["stops_ahead"]], {"median_error": F.col(predicted) - F.col("seconds_to_arrival")}, [0.5])
    return found.select("stops_ahead", F.col("median_error")[0].alias("median_error"))


def blended(left: DataFrame, right: DataFrame, keys: list[str], share: float = 0.5, most: float = K.MAX_HORIZON_SEC) -> DataFrame:
    """``keys, a, b, blend``: two models' predictions where both have one, and their mean by ``share`` of the first, within 0 and ``most``."""
    both = left.select(*keys, F.col("predicted").alias("a")).join(right.select(*keys, F.col("predicted").alias("b")), keys).dropna(subset=["a", "b"])
    return both.withColumn("blend", F.least(F.greatest(share * F.col("a") + (1 - share) * F.col("b"), F.lit(0.0)), F.lit(most)))
