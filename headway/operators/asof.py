"""As-of joins without inequality: union of both sides, and the last value along an order that is cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, at_left: Column, at_right: Column, values: list[str], block: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before it, by equal ``by``; nulls without one.

    The order is a number on both sides (epoch days or seconds), cut into blocks of ``block``. Within a block the last
    value is a window over both sides' rows; what earlier blocks carry in is one row for each block, over which another
    window runs. So rows are dealt by block even without ``by``, and only block summaries meet in one place. Of right
    rows at one time the greatest values count; right rows without time and left rows without time or ``by`` match nothing.
    """
    kept = F.struct(*values)
    l = left.select(*by, F.struct(*left.columns).alias("l"), at_left.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(kept).schema[0].dataType).alias("v"))
    r = right.where(at_right.isNotNull()).groupBy(*by, at_right.alias("at")).agg(F.max(kept).alias("v"))
    both = l.unionByName(r.select(*by, F.lit(None).cast(l.schema["l"].dataType).alias("l"), "at", F.lit(0).alias("side"), "v")).withColumn("block", F.floor(F.col("at") / block))
    within = Window.partitionBy(*by, "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("found", F.last("v", ignorenulls=True).over(within)).where("side = 1")
    ends = both.groupBy(*by, "block").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "v"))).alias("last"))
    carried = ends.select(*by, "block", F.last("last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    met = here.join(carried, [*by, "block"], "left")
    value = F.when(F.col("at").isNotNull(), F.coalesce("found", F.col("carried.v")))
    return met.withColumn("value", value).select("l.*", *(F.col(f"value.{c}").alias(c) for c in values))
