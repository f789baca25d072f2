import random

import pytest
from pyspark.sql import functions as F

from headway.operators import matching as M
from headway.operators import schedule as SC
from headway.operators import shapes as SH

POINT = "k int, shape_id string, x double, y double"


def rows_of(df):
    return sorted((r["k"], r["shape_id"], round(r["off_m"], 6), round(r["along_m"], 6), round(r["tangent"], 6)) for r in df.collect())


def test_grid_equals_all_segments(spark):
    """Crossing, doubled back, very long, very short and pointlike segments; points near, far and on cell edges."""
    pick = random.Random(7)
    lines = {"zig": [(i * 90.0, (i % 2) * 700.0) for i in range(40)], "back": [(0.0, 0.0), (2000.0, 0.0), (0.0, 0.0), (0.0, 0.0), (-3000.0, 5.0)], "long": [(-50_000.0, -20_000.0), (50_000.0, 20_000.0)], "walk": [(pick.uniform(-900, 900), pick.uniform(-900, 900)) for _ in range(60)]}
    segs = SH.segments(spark.createDataFrame([(s, i, *p) for s, ps in lines.items() for i, p in enumerate(ps)], "shape_id string, seq int, x double, y double")).cache()
    places = [(pick.uniform(-2500, 4500), pick.uniform(-1500, 1500)) for _ in range(150)] + [(500.0, 0.0), (500.0, 500.0), (-500.0, -1000.0), (90_000.0, 9.0), (0.0, 0.0)]
    points = spark.createDataFrame([(i * 10 + j, s, *p) for i, p in enumerate(places) for j, s in enumerate(lines)] + [(9999, "zig", None, 1.0), (9998, "none", 1.0, 1.0)], POINT)
    want = rows_of(SH.project(points.where("x IS NOT NULL"), segs, ["k"]))
    for cell in (100.0, 500.0, 4000.0):
        assert rows_of(SH.project_by_cells(points, segs, ["k"], cell)) == want, cell
    assert rows_of(SH.project_within(points, segs, ["k"], 75.0)) == [w for w in want if w[2] < 75]
    assert SH.project_by_cells(points.limit(0), segs, ["k"]).count() == 0 and SH.project_by_cells(points, segs.limit(0), ["k"]).count() == 0


def test_grid_compares_a_fraction(spark):
    segs = SH.segments(spark.range(1000).select(F.lit("s").alias("shape_id"), F.col("id").alias("seq"), (F.col("id") * 100.0).alias("x"), (F.col("id") % 7 * 10.0).alias("y")))
    points = spark.range(500).select(F.col("id").cast("int").alias("k"), F.lit("s").alias("shape_id"), (F.col("id") * 199.0).alias("x"), F.lit(40.0).alias("y"))
    r = SH.cell_pairs(points, segs, ["k"], 200.0).first()
    assert r["n_all"] == 500 * 999 and r["n_pairs"] < 0.05 * r["n_all"]


def test_elapsed_after_midnight(spark):
    rows = spark.createDataFrame([(600, 82_800, 90_000), (600, 3600, 7200), (84_000, 82_800, 90_000), (600, 82_800, 86_000)], "now int, a int, b int")
    assert [r[0] for r in rows.select(SC.elapsed(F.col("now"), F.col("a"), F.col("b"))).collect()] == [4200, -3000, 1200, -82_200]


@pytest.fixture(scope="module")
def network(spark):
    """Route A: two trips east on y = 0 and one back; route B: a trip on y = 60, in service on another day only."""
    pts = [("east", 0, 0.0, 0.0), ("east", 1, 1000.0, 0.0), ("west", 0, 1000.0, 5.0), ("west", 1, 0.0, 5.0), ("b", 0, 0.0, 60.0), ("b", 1, 1000.0, 60.0)]
    segs = SH.segments(spark.createDataFrame(pts, "shape_id string, seq int, x double, y double"))
    trips = spark.createDataFrame([("a1", "A", "east", "x"), ("a2", "A", "east", "x"), ("a3", "A", "west", "x"), ("b1", "B", "b", "y")], "trip_id string, route_id string, shape_id string, service_id string")
    services = spark.createDataFrame([(1, "x"), (2, "y")], "day int, service_id string")
    times = spark.createDataFrame([("a1", 0, 1000), ("a2", 5000, 6000), ("a3", 0, None)], "trip_id string, first_sec int, last_sec int")
    profile = spark.createDataFrame([("a1", 0.0, 0), ("a1", 1000.0, 1000), ("a2", 0.0, 0), ("a2", 1000.0, 1000)], "trip_id string, dist_m double, cum_sec int")
    return trips, segs, services, times, profile


FIX = "vehicle_id string, seq int, route_id string, x double, y double, bearing double, reported_trip_id string, day int, now_sec int"


def test_paths(spark, network):
    fixes = [
        ("v", 1, "A", 500.0, 1.0, 90.0, "a2", 1, 500),  # near its reported trip
        ("v", 2, "A", 500.0, 1.0, 90.0, None, 1, 500),  # a1 is where it should be by its schedule
        ("v", 3, "A", 500.0, 1.0, 270.0, None, 1, 500),  # heads back
        ("v", 4, None, 500.0, 1.0, 90.0, "a1", 1, 500),
        ("v", 5, "A", None, 1.0, 90.0, "a1", 1, 500),
        ("v", 6, "A", 500.0, 3000.0, None, "nobody", 1, 500),  # far from all
        ("v", 7, "A", 500.0, 1.0, None, None, 3, 500),  # no service
        ("v", 8, "B", 500.0, 61.0, None, "b1", 1, 500),  # reported trip isn't in service that day
        ("v", 9, "A", 500.0, 1.0, 270.0, "a1", 1, 500),  # near its reported trip, heading the other way
        ("w", 1, "", 500.0, 1.0, None, "a1", 1, 500),
    ]
    df = spark.createDataFrame(fixes, FIX)
    got = {m: {(r["vehicle_id"], r["seq"]): (r["path"], r["trip_id"]) for r in M.match_fixes(df, *network, mode=m).collect()} for m in ("batch", "live")}
    same = {("v", 1): ("reported", "a2"), ("v", 2): ("matched", "a1"), ("v", 3): ("matched", "a3"), ("v", 4): ("unplaced", None), ("v", 5): ("unplaced", None), ("v", 7): ("unmatched", None), ("w", 1): ("unplaced", None)}
    assert got["batch"] == {**same, ("v", 6): ("unmatched", None), ("v", 8): ("reported", "b1"), ("v", 9): ("reported", "a1")}
    live6 = got["live"][("v", 6)]
    assert got["live"] == {**same, ("v", 6): live6, ("v", 8): ("unmatched", None), ("v", 9): ("matched", "a3")} and live6[0] == "matched"
    far = {r["seq"]: r for r in M.match_fixes(df, *network).where("seq = 6").collect()}[6]
    assert far["off_m"] is None and far["min_off_m"] == pytest.approx(2995)
    assert M.match_fixes(df.limit(0), *network).count() == 0
    assert [r["path"] for r in M.match_fixes(df.where("seq = 2"), network[0].limit(0), *network[1:]).collect()] == ["unmatched"]


def test_reported_fixes_meet_no_candidates(spark, network):
    """Candidates are joined to the rest only: without any of the route's trips the believed ones still stand."""
    trips, *others = network
    df = spark.createDataFrame([("v", i, "elsewhere", 500.0, 1.0, 90.0, "a1", 1, 500) for i in range(5)], FIX)
    assert {(r["path"], r["trip_id"]) for r in M.match_fixes(df, trips, *others).collect()} == {("reported", "a1")}


def test_route_index(spark):
    from headway.operators import schedule as SC

    trips = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "c")], "route_id string, trip_id string")
    times = spark.createDataFrame([("a", "s1", 1), ("a", "s9", 3), ("a", "s2", 1), ("c", "s5", 7), ("x", "s5", 7), (None, "s5", 7)], "trip_id string, stop_id string, stop_sequence int")
    got = sorted(map(tuple, SC.route_index(trips, times).collect()))
    assert got == [("q", "c", 1, "s5", "s5"), ("r", "a", 3, "s1", "s9")]
    assert SC.route_index(trips, times.limit(0)).isEmpty()
