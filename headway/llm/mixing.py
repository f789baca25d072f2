"""Mixing sources to target weights by hash thresholds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import WORD, materialize

#: Bits of the hash that one level of a histogram resolves, and the number of levels.
LEVEL_BITS, LEVELS = 12, 3
#: A document is repeated so often at most.
MOST_REPEATS = 3


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _level(h, level: int):
    return F.shiftright(h, 60 - LEVEL_BITS * (level + 1)).bitwiseAND((1 << LEVEL_BITS) - 1)


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target``: weights 1, 2, 3 repeating by code point (null last) share the total size.

    Targets stop at MOST_REPEATS times the source's size; what is above is shared again by weight. That fixed point
    is a water level: sources sorted by ``cap / weight`` are capped up to the first one the level doesn't reach.
    One row a source, so its windows run over as many rows as there are sources.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", (F.pmod(F.row_number().over(everything) - 1, F.lit(3)) + 1).cast("decimal(38,0)"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * MOST_REPEATS).cast("decimal(38,0)"))
    by_level = Window.orderBy((F.col("source_size") / F.col("w").cast("double")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    left = weighed.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("decimal(38,0)").alias("num"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)").alias("den"),
        F.row_number().over(by_level).alias("pos"),
    )
    reached = F.when((F.col("num") * F.col("w")).cast("double") <= (F.col("cap") * F.col("den")).cast("double"), F.struct("pos", "num", "den"))
    level = left.withColumn("at", F.min(reached).over(all_rows))
    return level.select(
        "source",
        "source_size",
        F.when(F.col("pos") < F.col("at.pos"), F.col("cap").cast("double")).otherwise((F.col("at.num") * F.col("w")).cast("double") / F.col("at.den").cast("double")).alias("target"),
    )


def _hashed(doc_id: str, seed: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mixing_plan(sized: DataFrame) -> DataFrame:
    """``source, source_size, target, full, cut`` from ``sized(source, size, h)``: whole rounds, and the threshold of one more."""
    targets = materialize(source_targets(sized), "mix-targets").select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("long").alias("full"))
    bounds = targets.select("source", (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = sized if not level else sized.join(bounds.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", 60 - LEVEL_BITS * level) == F.col("prefix"))).drop("s", "prefix")
        sums = inside.groupBy("source", _level(F.col("h"), level).alias("bucket")).agg(F.sum("size").alias("here"))
        upto = sums.withColumn("upto", F.sum("here").over(Window.partitionBy("source").orderBy("bucket")))
        found = upto.join(bounds.select(F.col("source").alias("s"), "rest", "before", "prefix"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("before") + F.col("upto") > F.col("rest"))
        bounds = found.groupBy("source").agg(F.min(F.struct("bucket", "upto", "here", "rest", "before", "prefix")).alias("b")).select(
            "source", "b.rest", (F.col("b.before") + F.col("b.upto") - F.col("b.here")).alias("before"), (F.col("b.prefix") * (1 << LEVEL_BITS) + F.col("b.bucket")).alias("prefix"), F.col("b.here").alias("here")
        )
        bounds = materialize(bounds, f"mix-level{level}")
    nearer = F.when(F.col("before") + F.col("here") - F.col("rest") < F.col("rest") - F.col("before"), 1).otherwise(0)
    cut = bounds.select(F.col("source").alias("s"), (F.col("prefix") + nearer).alias("cut"))
    return materialize(targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "full", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-plan")


def mix_sources(docs: DataFrame, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` and ``keep`` for every row of ``docs(doc_id, text, source)``.

    A source takes all its documents ``floor(target / source_size)`` times, and once more those whose hash lies below
    a threshold. The threshold is found from histograms: sizes are summed by source and by the leading 12 bits of the
    hash, only the bucket that holds the boundary is summed again by the next 12 bits, and so on for 36 bits; the last
    bucket is taken if that comes nearer to the target. Nothing is sorted, a hot source is summed before the shuffle,
    and the decision is a filter on each row's own hash, so that reruns agree.

    A null text has size 0; null sources form one source; rows that share a doc_id share a decision. Columns to keep
    must not be named like the results.
    """
    sized = materialize(docs.select("doc_id", "source", n_words().alias("size"), _hashed("doc_id", seed).alias("h")), "mix-sizes")
    plan = mixing_plan(sized).withColumnRenamed("source", "s")
    rows = docs.select("doc_id", "source", n_words().alias("size"), _hashed("doc_id", seed).alias("h"), *keep) if keep else sized
    more = F.when(F.shiftright("h", 60 - LEVEL_BITS * LEVELS) < F.col("cut"), 1).otherwise(0)
    taken = (F.col("size") * F.least(F.col("full") + more, F.lit(MOST_REPEATS))).alias("taken")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", taken, *keep)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT // 16777216 AS p
  FROM documents),
weighed AS (
  SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER lv AS pos, sum(source_size) OVER () - COALESCE(sum(3 * source_size) OVER (lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER (lv ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM weighed WINDOW lv AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST)),
lvl AS (SELECT min(pos) AS p0 FROM levels WHERE (num * w)::DOUBLE <= (3 * source_size * den)::DOUBLE),
targets AS (
  SELECT l.source, l.source_size::BIGINT AS source_size,
         CASE WHEN l.pos < p0 THEN (3 * l.source_size)::DOUBLE ELSE (a.num * l.w)::DOUBLE / a.den::DOUBLE END AS target
  FROM levels l CROSS JOIN lvl JOIN levels a ON a.pos = p0),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS full_rounds FROM targets),
groups AS (SELECT source, p, sum(size)::BIGINT AS here FROM sized GROUP BY source, p),
sums AS (SELECT *, sum(here) OVER (PARTITION BY source ORDER BY p) AS upto FROM groups),
edge AS (
  SELECT s.source, s.p, s.here, s.upto - s.here AS before, t.target - t.full_rounds * t.source_size AS rest
  FROM sums s JOIN planned t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.upto > t.target - t.full_rounds * t.source_size
  QUALIFY row_number() OVER (PARTITION BY s.source ORDER BY s.p) = 1),
cuts AS (SELECT source, p + CASE WHEN before + here - rest < rest - before THEN 1 ELSE 0 END AS cut FROM edge)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * least(t.full_rounds + CASE WHEN d.p < COALESCE(c.cut, 0) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM sized d JOIN planned t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""
