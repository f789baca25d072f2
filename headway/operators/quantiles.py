"""Exact quantiles by rank refinement: brackets around the ranks narrow over passes, and only what they hold is sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.staging import written

#: Steps of the sketch's grid, and its relative rank error (at most ``1 / ACCURACY``, by which the margin must exceed it).
GRID, ACCURACY, MARGIN = 1000, 10_000, 3
#: Rows of a cell that the exact aggregate may buffer; a task may hold 128 such cells before it sorts them.
BUFFERED = 50_000
#: Brackets (cells, names and probabilities) that are sent to every task rather than meet a cell's rows in one.
MOST_BROADCAST = 100_000


def quantiles(rows: DataFrame, sets: list[list[str]], values: dict[str, Column], probabilities: list[float], rounds: int | None = None, buffered: int = BUFFERED) -> DataFrame:
    """``set, keys, n_<name>, <name>`` for each set of keys and cell: counts and arrays of quantiles of the values that aren't null.

    Quantiles lie between neighbours in proportion, as ``percentile`` has them, and are exact. Keys outside of a set are
    null; ``set`` is its number. A cell without any value of a name has count 0 and nulls; one without any value at all is absent.

    Cells are counted first. Sets whose largest cell has ``buffered`` rows at most are left to ``percentile``, whose
    buffers that bounds; the others are refined, by as many ``rounds`` as their largest cell takes unless given. The
    values are written once, unless ``rows`` is a written table, as each pass reads them.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    slim = rows.select(*keys, *(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())))
    slim = slim if hasattr(rows, "written_to") else written(slim, "quantiles")
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): n for n, s in enumerate(sets)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)), F.col("g").cast("int")) if keys else F.lit(0)
    grouped = (lambda some: slim.groupingSets(some, *keys)) if keys else (lambda some: slim.groupBy())
    g = (F.grouping_id() if keys else F.lit(0)).alias("g")
    counted = grouped(sets).agg(F.count("*").alias("n"), g).groupBy(number.alias("set")).agg(F.max("n").alias("n"), F.count("*").alias("cells")).collect()
    largest, n_cells = ({r["set"]: r[c] for r in counted} for c in ("n", "cells"))
    small = [i for i in range(len(sets)) if largest.get(i, 0) <= buffered]
    large = [i for i in range(len(sets)) if i not in small]
    names = ["set", *keys, *(c for name in values for c in (f"n_{name}", name))]
    out = None
    if small:
        aggregates = []
        for i, name in enumerate(values):
            v = F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))
            aggregates += [F.count(v).alias(f"n_{name}"), F.coalesce(F.percentile(v, probabilities), F.array(*[F.lit(None).cast("double")] * len(probabilities))).alias(name)]
        cells = grouped([sets[i] for i in small]).agg(*aggregates, g).withColumn("set", number)
        out = cells.where(" + ".join(f"`n_{name}`" for name in values) + " > 0").select(*names)
    sendable = [i for i in large if n_cells.get(i, 0) * len(values) * len(probabilities) <= MOST_BROADCAST]
    for some in (sendable, [i for i in large if i not in sendable]):
        if some:
            refined = _refined(slim, keys, [(i, sets[i]) for i in some], list(values), probabilities, rounds or rounds_for(max(largest.get(i, 0) for i in some)), some == sendable).select(*names)
            out = refined if out is None else out.unionByName(refined)
    return out


def _refined(slim: DataFrame, keys: list[str], sets: list[tuple[int, list[str]]], values: list[str], probabilities: list[float], rounds: int, sent: bool) -> DataFrame:
    """Quantiles of cells of any size.

    First every cell and name gets a count and a mergeable sketch. From the sketch's grid a bracket is read that must
    hold the ranks wanted, as its margin is ``MARGIN * ACCURACY / GRID`` times the sketch's error. Each further round
    sketches what a bracket holds, which leaves about a hundredth. At last what lies below a bracket is counted, equal
    values within it are summed before the shuffle, and only their counts are put in order. No task holds a cell's
    values, and a rank outside of its bracket is an error. Brackets are ``sent`` to the rows where they are few: a join by
    cell would bring all rows of the global cell to one task.
    """
    bounds = F.broadcast if sent else (lambda df: df)
    masked = [F.struct(F.lit(i).alias("set"), *((F.col(k) if k in s else F.lit(None).cast(slim.schema[k].dataType)).alias(k) for k in keys)) for i, s in sets]
    named = F.array(*(F.struct(F.lit(i).alias("name"), F.col(f"v{i}").alias("v")) for i in range(len(values))))
    tall = slim.select(F.explode(F.array(*masked)).alias("cell"), named.alias("x")).select("cell", F.explode("x").alias("x")).select("cell", "x.name", "x.v").where("v IS NOT NULL AND NOT isnan(v)")

    grid = [i / GRID for i in range(GRID + 1)]
    sketch = F.percentile_approx("v", grid, ACCURACY)
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(p).alias("share")) for i, p in enumerate(probabilities))))
    state = tall.groupBy("cell", "name").agg(F.count("*").alias("n"), sketch.alias("grid"))
    state = state.withColumn("w", wanted).select("cell", "name", "n", "grid", "w.*").withColumn("at", (F.col("n") - 1) * F.col("share"))
    state = state.withColumns({"r0": F.floor("at"), "r1": F.ceil("at"), "below": F.lit(0).cast("long"), "within": F.col("n")})
    for _ in range(rounds - 1):
        state = _narrowed(state)
        held = tall.join(bounds(state.select("cell", "name", "p", "low", "high")), ["cell", "name"])
        seen = held.groupBy("cell", "name", "p").agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("within"), F.percentile_approx(F.when(F.col("v").between(F.col("low"), F.col("high")), F.col("v")), grid, ACCURACY).alias("grid"))
        state = state.drop("below", "within", "grid", "low", "high").join(seen, ["cell", "name", "p"])
    state = _narrowed(state).drop("grid", "below", "within")
    met = tall.join(bounds(state.select("cell", "name", "p", "low", "high")), ["cell", "name"]).where("v <= high")
    counted = met.groupBy("cell", "name", "p", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("cell", "name", "p").orderBy(F.asc_nulls_first("v"))
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).join(state, ["cell", "name", "p"]).where("v IS NOT NULL")
    first = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("v")))
    ends = ranked.groupBy("cell", "name", "p").agg(F.first("at").alias("at"), F.first("n").alias("n"), F.first("r0").alias("r0"), F.first("r1").alias("r1"), first("r0").alias("q0"), first("r1").alias("q1"), F.min(F.col("upto") - F.col("c")).alias("before"))
    lost = F.col("q1").isNull() | (F.col("before") > F.col("r0"))
    share = F.col("at") - F.col("r0")
    value = F.when(lost, F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")).when(F.col("q0") == F.col("q1"), F.col("q0")).otherwise((1 - share) * F.col("q0") + share * F.col("q1"))
    done = ends.select("cell", "name", "p", "n", value.alias("q"))
    one = lambda i, p: F.max(F.when((F.col("name") == i) & (F.col("p") == p), F.col("q")))
    columns = []
    for i, name in enumerate(values):
        columns += [F.coalesce(F.max(F.when(F.col("name") == i, F.col("n"))), F.lit(0).cast("long")).alias(f"n_{name}"), F.array(*(one(i, p) for p in range(len(probabilities)))).alias(name)]
    return done.groupBy("cell").agg(*columns).select("cell.*", *(c for name in values for c in (f"n_{name}", name)))


def _narrowed(state: DataFrame) -> DataFrame:
    """The bracket of each rank from the grid over what the last bracket held."""
    place = lambda r, way: way((F.col(r) - F.col("below")) / F.col("within") * GRID)
    low = F.greatest(F.lit(0), place("r0", F.floor) - MARGIN)
    high = F.least(F.lit(GRID), F.ceil((F.col("r1") + 1 - F.col("below")) / F.col("within") * GRID) + MARGIN)
    return state.withColumns({"low": F.get("grid", low.cast("int")), "high": F.get("grid", high.cast("int"))})


def rounds_for(largest_cell: int) -> int:
    """Rounds after which a bracket holds about a million of so many values."""
    width = (2 * MARGIN + 2) / GRID
    return max(1, math.ceil(math.log(max(1, largest_cell / 1e6)) / -math.log(width)))
