"""Checks on snapshots and feeds: day statistics, deduplication, staleness, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway import constants as K
from headway.operators.folds import folded
from headway.operators.quantiles import quantiles


def day_statistics(positions: DataFrame, day: str = "service_date", low: int = 1000) -> DataFrame:
    """Rows, distinct ids, nulls and time range of each day; ``is_low`` for days of few rows."""
    return positions.groupBy(day).agg(F.count("*").alias("n"), F.count_distinct("vehicle_id").alias("n_vehicles"), F.count_distinct("route_id").alias("n_routes"), F.count_distinct("trip_id").alias("n_trips"), F.count_if(F.col("bearing").isNull()).alias("null_bearings"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).withColumn("is_low", F.col("n") < low)


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles, 90th and 95th percentile and largest of a column, exact."""
    q = quantiles(rows, [[]], {"q": F.col(column)}, [0.25, 0.5, 0.75, 0.9, 0.95]).select("q")
    d = rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return d.join(F.broadcast(q), how="left").select("n", "mean", "std", "min", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95))), "max")


def dedup_fixes(positions: DataFrame, keys: tuple[str, ...] = ("vehicle_id", "feed_ts"), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each vehicle and feed time, the first in order; aggregated before the shuffle."""
    rest = [c for c in positions.columns if c not in keys]
    first = positions.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def silver_gate(positions: DataFrame, snapshots: str = "feed_ts", day: str = "service_date", share: float = 0.9) -> DataFrame:
    """Whether a day has that share of the rows that its snapshots and their median number of vehicles promise."""
    each = positions.groupBy(day, snapshots).agg(F.count_distinct("vehicle_id").alias("v"), F.count("*").alias("rows"))
    per_day = each.groupBy(day).agg(F.sum("rows").alias("n"), F.count("*").alias("n_snapshots"), F.expr("percentile(v, 0.5)").alias("median_vehicles"))
    return per_day.withColumn("passes", F.col("n") >= share * F.col("n_snapshots") * F.col("median_vehicles"))


def stale_days(fixes: DataFrame, day: str = "service_date", most: int = 120) -> DataFrame:
    """``day, median_age_sec, is_stale``: whether half of a day's fixes were older than that when they were served.

    Ages are whole seconds: they are counted by value first, so that no task holds more than the different ages.
    """
    ages = fixes.groupBy(day, (F.col("feed_ts") - F.col("fix_ts")).cast("long").alias("age")).agg(F.count("*").alias("n"))
    return ages.groupBy(day).agg(F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age_sec")).withColumn("is_stale", F.col("median_age_sec") > most)


def staleness(fixes: DataFrame, stale: int = K.STALE_FIX_SEC, slide: int = K.STALE_SLIDE_SEC) -> DataFrame:
    """Adds ``reference_ts, skew_sec, is_stale`` to ``fixes(feed_ts, fix_ts)``.

    The reference is the feed's own time, and its newest fix where that trails the feed by more than a fix may be old,
    up to half an hour. The newest fix is a maximum by feed, joined back, as a feed holds a whole fleet.
    """
    newest = fixes.groupBy("feed_ts").agg(F.max(F.when(F.col("fix_ts") > 0, F.col("fix_ts"))).alias("newest"))
    skew = F.coalesce(F.col("feed_ts") - F.col("newest"), F.lit(0))
    slides = (skew > stale) & (skew <= slide)
    rows = fixes.join(newest, "feed_ts").withColumn("skew_sec", F.greatest(skew, F.lit(0))).withColumn("reference_ts", F.when(slides, F.col("newest")).otherwise(F.col("feed_ts")))
    return rows.withColumn("is_stale", F.coalesce(F.col("reference_ts") - F.col("fix_ts") > stale, F.lit(False))).drop("newest")


def collapse_guard(passes: DataFrame, least: int = 20, ratio: float = 0.3, by: str | None = None) -> DataFrame:
    """``[by,] pass_no, n_entities, published``: a pass far smaller than the last *published* one is held back.

    A fold over the passes of one day or feed (``by``), as what was held back doesn't move the reference.
    """
    keys = [by] if by else []
    runs = passes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pass_no", "n_entities"))).alias("f"))
    ok = f"(s IS NULL OR s < {least} OR x.n_entities >= s * {ratio})"
    out = f"named_struct('pass_no', x.pass_no, 'n_entities', x.n_entities, 'published', {ok})"
    return runs.select(*keys, F.inline(folded("f", "cast(null AS bigint)", f"IF({ok}, x.n_entities, s)", out, "struct<pass_no:bigint,n_entities:bigint,published:boolean>")))


def horizon_fence(fixes: DataFrame, stops: DataFrame, max_ahead: int = K.MAX_STOPS_AHEAD) -> DataFrame:
    """The first stop beyond the served horizon of each fix, which the feed marks as without data."""
    nested = stops.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(F.col("stop_dist_m").alias("d"), F.col("stop_id").alias("id"), F.col("stop_sequence").alias("seq")))).alias("s"))
    met = fixes.join(nested, "trip_id").withColumn("x", F.expr(f"try_element_at(filter(s, s -> s.d > dist_m), {max_ahead + 1})")).where("x IS NOT NULL")
    return met.select("vehicle_id", "trip_id", "seq", F.col("x.id").alias("stop_id"), F.col("x.seq").alias("stop_sequence"))


def skip_repeated_feeds(feeds: DataFrame) -> DataFrame:
    """Snapshots whose feed time is that of the one before are dropped."""
    w = Window.partitionBy().orderBy("polled_at") if "source" not in feeds.columns else Window.partitionBy("source").orderBy("polled_at")
    return feeds.withColumn("last", F.lag("feed_ts").over(w)).where("last IS NULL OR last <> feed_ts").drop("last")
