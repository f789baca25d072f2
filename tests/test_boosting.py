import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from headway.functions import serving
from headway.models import boosting as BO
from headway.operators import serving as SV

COLUMNS = ("a", "b")


def noisy(spark, days=10, rows_a_day=60, seed=4):
    """A step in ``a`` under heavy noise: what later stages learn is the training days' noise."""
    pick = random.Random(seed)
    out = []
    for d in range(days):
        for _ in range(rows_a_day):
            a, b = pick.random(), pick.random()
            out.append((dt.date(2024, 1, 1) + dt.timedelta(d), a, b, 300.0 * (a > 0.5) + pick.gauss(0, 80), 1.0 + (b > 0.9)))
    return spark.createDataFrame(out, "service_date date, a double, b double, y double, w double").repartition(4, "service_date").sortWithinPartitions("service_date", "a")


def test_validation_days_are_whole(spark):
    rows = BO.with_validation_days(noisy(spark, 10, 3), share=0.3)
    marked = {r["service_date"].day: r["v"] for r in rows.groupBy("service_date").agg(F.collect_set("is_validation").alias("v")).collect()}
    assert marked == {d: [d > 7] for d in range(1, 11)}
    assert BO.with_validation_days(rows.where("service_date = DATE'2024-01-01'").drop("is_validation")).where("is_validation").count() == 0
    assert BO.with_validation_days(rows.limit(0).drop("is_validation")).count() == 0


def test_grain_medians(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 1.0), ("b", -5.0, 1.0), ("b", 7.0, 3.0)], "k string, v double, w double")
    got = {r["k"]: r["median"] for r in BO.grain_medians(rows, ["k"], "v", "w").collect()}
    assert got == {"a": pytest.approx(2, abs=0.1), "b": pytest.approx(7, abs=0.1)}


def test_stops_early_at_the_least_error(spark):
    rows = BO.with_validation_days(noisy(spark), share=0.4)
    grow = lambda: BO.boost(rows, "y", "w", columns=COLUMNS, max_iter=15, patience=2, step=1.0, depth=3, least_leaf=2)
    model = grow()
    assert 0 < len(model.trees) == model.stages_grown - 2 < 13
    assert min(model.errors) == model.errors[len(model.trees)] < 0.7 * model.errors[0]
    kept_back = model.score(rows.where("is_validation"))
    held = kept_back.agg(F.sum(F.col("w") * F.abs(F.col("predicted") - F.col("y"))) / F.sum("w")).first()[0]
    assert held == pytest.approx(min(model.errors)), "the trees kept give the error that chose them"
    again = grow()
    assert again.trees == model.trees and again.errors == model.errors


def test_without_validation_rows(spark):
    rows = noisy(spark, 2, 20).withColumn("is_validation", F.lit(None).cast("boolean"))
    model = BO.boost(rows, "y", columns=COLUMNS, max_iter=3, depth=2)
    assert len(model.trees) == model.stages_grown == 3
    with pytest.raises(ValueError):
        BO.boost(rows.where("false"), "y", columns=COLUMNS)


def test_the_running_table_is_never_cached(spark, monkeypatch):
    """It outgrows the executors' heaps; and only the table of the stage before is kept on disk beside the one that is written."""
    rows = BO.with_validation_days(noisy(spark, 4, 20), share=0.4)
    cached, live, most = [], set(), []
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(rows), name, lambda df, *a, f=getattr(type(rows), name): cached.append(df) or f(df, *a))

    def write(df, label, f=BO.written):
        live.add((out := f(df, label)).written_to)
        most.append(len(live))
        return out

    monkeypatch.setattr(BO, "written", write)
    monkeypatch.setattr(BO, "discard", lambda *tables, f=BO.discard: (live.difference_update(t.written_to for t in tables), f(*tables)))
    model = BO.boost(rows, "y", "w", columns=COLUMNS, max_iter=3, depth=2, least_leaf=2)
    assert model.stages_grown == 3 and not cached and most == [1, 2, 2, 2] and not live


def test_horizon_gaps(spark):
    """Between the shortest and the longest horizon, one that a table lacks has the longest's value."""
    table = F.create_map(*map(F.lit, (1, 10, 2, 5, 5, 15)))
    assert list(spark.range(1).select(*(serving.horizon_value(table, F.lit(h)).alias(f"h{h}") for h in (0, 1, 2, 3, 4, 5, 9))).first()) == [None, 10, 5, 15, 15, 15, 15]
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), h) for h in range(6)], "service_date date, stops_ahead int")
    tables = spark.createDataFrame([("flat", 1, 10), ("flat", 2, 5), ("flat", 5, 15)], "kind string, stops_ahead int, bias_sec int")
    assert {r["stops_ahead"]: r["bias_sec"] for r in SV.with_bias(rows, tables).collect()} == {0: 0, 1: 10, 2: 5, 3: 15, 4: 15, 5: 15}


def test_nearest_shape_counts_the_own(spark):
    fixes = spark.createDataFrame([(1, 120.0), (2, 90.0), (3, 500.0), (4, None), (5, None), (6, 700.0)], "k int, matched_off_m double")
    near = spark.createDataFrame([(1, 300.0), (1, 400.0), (2, 10.0), (3, 30.0), (4, 20.0)], "k int, off_m double")
    assert {r["k"]: r["off_m"] for r in SV.nearest_shape(fixes, near, ["k"]).collect()} == {1: 120, 2: 90, 3: 30, 4: 20, 5: None, 6: 700}
