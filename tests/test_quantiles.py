import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators.quantiles import quantiles, rounds_for

P = [0.0, 0.25, 0.5, 0.9, 1.0]


def rows(n=4000, seed=5):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        route = pick.choice(["a", "a", "a", "b", None])
        out.append((route, pick.randrange(3), pick.choice([None, pick.gauss(0, 1) * 10 ** pick.randint(-200, 200), pick.gauss(0, 1), 7.0, -0.0, float(i)]), pick.randrange(5)))
    return [*out, ("once", 1, 3.5, 0), ("never", 1, None, 2)]


@pytest.mark.parametrize(("rounds", "buffered"), [(1, 0), (3, 0), (None, 10**6), (2, 3000)])
def test_against_numpy(spark, rounds, buffered):
    data = rows()
    df = spark.createDataFrame(data, "route string, hour int, x double, k int").repartition(7)
    got = {(r["set"], r["route"], r["hour"]): r for r in quantiles(df, [["route", "hour"], ["route"], []], {"x": F.col("x"), "k": F.col("k") / 2}, P, rounds, buffered).collect()}
    cells = {}
    for route, hour, x, k in data:
        for cell in ((0, route, hour), (1, route, None), (2, None, None)):
            xs, ks = cells.setdefault(cell, ([], []))
            if x is not None:
                xs.append(x)
            ks.append(k / 2)
    assert got.keys() == cells.keys()
    for cell, (xs, ks) in cells.items():
        r = got[cell]
        assert (r["n_x"], r["n_k"]) == (len(xs), len(ks))
        assert r["k"] == pytest.approx(np.quantile(ks, P))
        if xs:
            assert np.allclose(r["x"], np.quantile(xs, P), rtol=1e-12)
        else:
            assert r["x"] == [None] * len(P)


def test_brackets_narrow_on_many_values(spark):
    """A global cell of different values: what is put in order is a small part of them."""
    n = 300_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) + 0.5).alias("v"))
    out = quantiles(df, [[]], {"v": F.col("v")}, [0.5, 0.999], rounds=2, buffered=1000).first()
    assert out["v"] == pytest.approx([n / 2, 0.5 + 0.999 * (n - 1)])
    assert (rounds_for(10**6), rounds_for(10**8), rounds_for(10**10)) == (1, 1, 2)


def test_no_rows(spark):
    df = spark.createDataFrame([], "route string, x double")
    for buffered in (0, 100):
        assert quantiles(df, [["route"], []], {"x": F.col("x")}, [0.5], buffered=buffered).count() == 0
        assert quantiles(df, [[]], {"x": F.col("x")}, [0.5], buffered=buffered).count() == 0
