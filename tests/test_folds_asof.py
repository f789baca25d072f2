import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from headway.operators import calibration as C
from headway.operators import schedule as SC
from headway.operators import trajectory as T
from headway.operators.asof import as_of
from headway.operators.folds import folded
from headway.streaming import live

DAY = 86_400.0


def test_folded_equals_a_loop(spark):
    pick = random.Random(6)
    arrays = [[pick.randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 7, 128, 129, 400)]
    df = spark.createDataFrame(list(enumerate(arrays)), "k int, f array<int>")
    for chunk in (1, 3, 64):
        got = {r["k"]: r["o"] for r in df.select("k", folded("f", "0", "IF(x % 3 = 0, 0, s + x)", "s * 100 + n", "int", chunk).alias("o")).collect()}
        for k, f in enumerate(arrays):
            s, want = 0, []
            for x in f:
                n = 0 if x % 3 == 0 else s + x
                want.append(s * 100 + n)
                s = n
            assert got[k] == want


def wandering(n, seed=1, step=10.0):
    pick = random.Random(seed)
    out, d = [], 0.0
    for i in range(n):
        d = max(0.0, d + pick.uniform(-60, 60))
        out.append(("v", "t", i, i * step, d, pick.choice([None, 20.0, 170.0])))
    return out


COLS = "vehicle_id string, trip_id string, seq long, t double, off_m double, bearing_diff double"


def status_by_loop(rows):
    state, out = None, {}
    for r in rows:
        state = live.advance_status(state, "same", r[4], r[5])
        out[r[2]] = state[1]
    return out


def test_status_over_blocks_equals_one_pass(spark):
    rows = wandering(3000)
    want = status_by_loop(rows)
    assert 20 < sum(want[i] != want[i - 1] for i in range(1, len(rows)))
    df = spark.createDataFrame(rows, COLS).repartition(5)
    for block in (10.0, 35.0, 1000.0, DAY):
        assert {r["seq"]: r["off_route"] for r in T.off_route_status(df, block_sec=block).collect()} == want, block
    assert T.off_route_status(df.limit(0)).count() == 0


def history(spark, n):
    """A vehicle's fixes of years, off route for five fixes in every hundred; made by Spark."""
    i = F.col("id")
    return spark.range(n).select(F.lit("v").alias("vehicle_id"), F.lit("t").alias("trip_id"), i.alias("seq"), (i * 10.0).alias("t"), F.when(i % 100 < 5, 400.0).otherwise(10.0 + i % 3).alias("off_m"), F.lit(0.0).alias("bearing_diff"), (F.floor(i / 7) * 30.0).alias("dist_m"))


def test_a_million_fixes_of_one_vehicle(spark):
    """Time grows with the history, not with its square, and the results are right at its end."""
    took = {}
    for n in (250_000, 1_000_000):
        began = time.time()
        s = T.off_route_status(history(spark, n)).where(F.col("seq") >= n - 100).agg(F.count("*").alias("n"), F.sum(F.col("off_route").cast("int")).alias("off"), F.min(F.when(F.col("off_route"), F.col("seq"))).alias("first")).first()
        assert tuple(s) == (100, 5, n - 98)
        took[n] = time.time() - began
    assert took[1_000_000] < 10 * took[250_000]
    began = time.time()
    r = T.stationary_seconds(history(spark, 1_000_000)).agg(F.count("*"), F.sum("stationary_sec")).first()
    assert r[0] == 1_000_000 and r[1] == pytest.approx(sum(10.0 * (i % 7) for i in range(1_000_000)))
    assert time.time() - began < 90


def test_as_of_against_brute_force(spark):
    pick = random.Random(8)
    left = [(i, pick.choice("ab"), pick.choice([None, *range(60)])) for i in range(200)]
    right = [(pick.choice("abc"), pick.choice([None, *range(0, 60, 3)]), pick.randrange(100)) for _ in range(40)]
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    for block in (1, 7, 1000):
        got = {x["i"]: x["v"] for x in as_of(l, r, F.col("t"), F.col("t"), ["v"], block, ("k",)).collect()}
        for i, k, t in left:
            known = [(rt, rv) for rk, rt, rv in right if rk == k and rt is not None and t is not None and rt <= t]
            assert got[i] == (max(known)[1] if known else None), (i, block)
    assert as_of(l.limit(0), r, F.col("t"), F.col("t"), ["v"], 5, ("k",)).count() == 0
    assert {x["v"] for x in as_of(l, r.limit(0), F.col("t"), F.col("t"), ["v"], 5, ("k",)).collect()} == {None}


def test_versions(spark):
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(d)
    days = spark.createDataFrame([(day(d),) for d in (0, 5, 6, 200, 900)], "day date")
    versions = spark.createDataFrame([(day(5), "v1"), (day(100), "v2"), (day(100), "v2b"), (day(901), "v3")], "day date, version string")
    got = SC.latest_version(versions, days, current="now")
    assert {r["day"]: r["version"] for r in got.collect()} == {day(0): "now", day(5): "v1", day(6): "v1", day(200): "v2b", day(900): "v2b"}
    assert {r["version"] for r in SC.latest_version(versions.limit(0), days).collect()} == {None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merged_bias(spark):
    flat = spark.createDataFrame([(1, 10), (2, 20)], "stops_ahead int, bias_sec int")
    live_ = spark.createDataFrame([("weekday", 1, 4)], "day string, stops_ahead int, bias_sec int")
    residual = spark.createDataFrame([("weekend", 2, 8.0), ("weekday", 1, 3.0)], "day string, stops_ahead int, bias_sec double")
    out = C.merge_bias(flat, live_, residual)
    assert {(r["day"], r["stops_ahead"]): r["bias_sec"] for r in out.collect()} == {("weekday", 1): 6, ("weekday", 2): 20, ("weekend", 1): 10, ("weekend", 2): 4}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
