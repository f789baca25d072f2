"""Steps whose cost once grew faster than their input: what they build is looked at in their plans and results."""

import pytest
from pyspark.sql import functions as F

from headway.functions.serving import isotonic
from headway.operators import linktime as L
from headway.operators import matching as M
from headway.operators import schedule as SC
from headway.operators import scoring as S
from headway.operators import shapes as SH
from headway.operators import trajectory as T
from headway.operators.quantiles import quantiles
from headway.plans import matching_queries as MQ
from headway.plans import scoring_queries as SQ
from headway.staging import written


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_stops_and_arrivals_are_never_broadcast(spark):
    """A few bytes of fixes become forty stops a trip, so the size of their files says nothing about the table of stops."""
    fixes = spark.createDataFrame([("v", "a", "r", 0.0, 1, 0.0), ("v", "a", "r", 60.0, 2, 150.0), ("v", "a", "r", 120.0, 3, 320.0)], "vehicle_id string, trip_id string, route_id string, t double, seq bigint, dist_m double")
    stops = spark.createDataFrame([("a", f"s{i}", i, i * 100.0) for i in range(6)], "trip_id string, stop_id string, stop_sequence int, stop_dist_m double")
    rows = T.training_rows(fixes, stops)
    assert "Broadcast" not in plan(rows) and "Broadcast" not in plan(T.with_stationary(fixes))
    got = {(r["seq"], r["stop_sequence"]): (r["stops_ahead"], r["stops_remaining"], r["seconds_to_arrival"]) for r in rows.collect()}
    assert got[1, 1] == (1, 4, 40.0) and got[1, 3] == (3, 2, pytest.approx(60 + 60 * 150 / 170)) and got[2, 2] == (1, 3, pytest.approx(60 * 50 / 170))


def test_brackets_are_sent_to_the_rows(spark):
    """The global cell's rows meet its bracket where they are, not in one task."""
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("k"), (F.col("id") * 7919 % 5000).cast("double").alias("v"))
    out = quantiles(df, [["k"], []], {"v": F.col("v")}, [0.5], rounds=2, buffered=100)
    text = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [cell" in text and "SortMergeJoin [cell" not in text.split("HashAggregate")[-1]
    assert out.where("set = 1").first()["v"] == [2499.5]


def test_services_are_asked_last(spark):
    """A trip isn't dealt out once for each of its days."""
    fixes = spark.createDataFrame([(1, "r", "2024-01-01", 36_000), (2, "r", "2024-01-02", 36_000), (3, "r", "2024-01-01", 80_000)], "k int, route_id string, day string, now_sec int")
    ways = spark.createDataFrame([("a", "r", "x"), ("b", "r", "y"), ("c", "r", "y")], "trip_id string, route_id string, service_id string")
    days = spark.createDataFrame([(f"2024-01-{d:02d}", "x") for d in range(1, 31)] + [("2024-01-02", "y")], "day string, service_id string")
    times = spark.createDataFrame([("a", 35_000, 37_000), ("b", 35_000, 37_000)], "trip_id string, first_sec int, last_sec int")
    out = SC.trips_at(fixes, ways, days, times)
    assert sorted((r["k"], r["trip_id"]) for r in out.collect()) == [(1, "a"), (2, "a"), (2, "b"), (2, "c")]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert all("LeftSemi" in line for line in joins if "day#" in line or "service_id#" in line)


def test_corrections_hold_no_horizon_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "quantiles", lambda rows, sets, *rest: seen.append(sets) or quantiles(rows, sets, *rest, buffered=2))
    rows = spark.createDataFrame([(h, float(v * v), 1.0) for h in (1, 2) for v in range(7)], "stops_ahead int, segment_eta double, seconds_to_arrival double")
    got = L.horizon_corrections(rows)
    assert seen == [[["stops_ahead"]]] and {r[0]: r[1] for r in got.collect()} == {1: 8.0, 2: 8.0}


def test_weekend_merge_takes_its_rows_once(spark, monkeypatch):
    made, daily = [], SQ._daily
    monkeypatch.setattr(SQ, "_daily", lambda *a: made.append(a[2:]) or daily(*a))
    assert SQ.QUERIES["weekend_merge"](spark, "/root/testdata/sf0.001").count() > 0
    assert made == [("day", "stops_ahead")]


def network(spark):
    """Shapes "0" to "49" of five segments along y = 0, and points near and far on two of them."""
    segs = SH.segments(spark.range(50).select(F.col("id").cast("string").alias("shape_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("seq")).select("shape_id", "seq", (F.col("seq") * 1000.0).alias("x"), F.lit(0.0).alias("y")))
    points = spark.createDataFrame([(1, "3", 2500.0, 40.0), (2, "3", 2500.0, 9000.0), (3, "7", -4000.0, 0.0)], "k int, shape_id string, x double, y double")
    return points, segs, {(1, 40.0, 2500.0), (2, 9000.0, 2500.0), (3, 4000.0, 0.0)}


def test_a_pair_of_point_and_segment_is_no_row(spark):
    points, segs, want = network(spark)
    for out in (SH.project(points, segs, ["k"]), SH.project_by_cells(points, segs, ["k"])):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [k#" not in text and "cx#" not in text
        assert {(r["k"], r["off_m"], r["along_m"]) for r in out.collect()} == want


def test_shapes_without_fixes_get_no_points(spark):
    """The grid's shapes are chosen before forty points are made of each."""
    points = MQ._on_shapes(spark, "/root/testdata/sf0.001")
    segs = MQ._network(spark, "/root/testdata/sf0.001", points)[1]
    text = segs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text[text.index("Generate") :]
    assert segs.select("shape_id").distinct().join(points, "shape_id", "left_anti").isEmpty()


def test_candidates_are_not_joined_again(spark):
    """A candidate has its place and schedule when it is made; trips that no fix asks for change nothing."""
    trips = spark.createDataFrame([("a", "A", "3", "x"), ("b", "A", "7", "x"), ("c", "B", "9", "x"), ("d", "C", "9", "x")], "trip_id string, route_id string, shape_id string, service_id string")
    fixes = spark.createDataFrame([("v", 1, "A", 2500.0, 60.0, 90.0, None, 1, 500), ("v", 2, "A", 10.0, 9.0, 90.0, "c", 1, 500), ("v", 3, "", 10.0, 9.0, 90.0, "d", 1, 500)], "vehicle_id string, seq int, route_id string, x double, y double, bearing double, reported_trip_id string, day int, now_sec int")
    times = spark.createDataFrame([(t, 0, 1000) for t in "abcd"], "trip_id string, first_sec int, last_sec int")
    profile = spark.createDataFrame([("a", 0.0, 0), ("a", 5000.0, 1000)], "trip_id string, dist_m double, cum_sec int")
    services = spark.createDataFrame([(1, "x")], "day int, service_id string")
    assert {r["trip_id"] for r in M.trips_asked(fixes.where("seq < 3"), trips).collect()} == {"a", "b", "c"}
    segs = network(spark)[1]
    for mode in ("batch", "live"):
        out = M.match_fixes(fixes, M.trips_asked(fixes, trips), segs, services, times, profile, mode)
        assert {(r["seq"], r["path"], r["trip_id"]) for r in out.collect()} == {(1, "matched", "a"), (2, "reported", "c"), (3, "unplaced", None)}
        joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert not [line for line in joins if "vehicle_id#" in line and "shape_id#" in line]


def test_isotonic_sums_once(spark):
    """The running sums are an expression of the whole array: once, not in each mean."""
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0, 4.0],), ([],)], "v array<double>").select(isotonic(F.col("v")).alias("fit"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r["fit"] for r in df.collect()] == [[2.0, 2.0, 2.0, 4.5, 4.5], []]


def test_predictions_and_arrivals_are_never_broadcast(spark):
    """Their files are small beside their rows: no join of scoring or coverage sends them to the driver and every task."""
    p = spark.createDataFrame([("v", "a", "s1", 1, 10, 70), ("v", "a", "s1", 1, 20, 80), ("w", "b", "s2", 2, 10, 900)], "vehicle_id string, trip_id string, stop_id string, stop_sequence int, feed_ts long, predicted_arrival long")
    a = spark.createDataFrame([("v", "a", "r", "s1", 1, 75), ("v", "c", "r", "s1", 1, 3000), ("w", "b", "r", "s3", 3, 75), ("x", "d", "r", "s1", 1, 75)], "vehicle_id string, trip_id string, route_id string, stop_id string, stop_sequence int, actual_arrival_ts long")
    p, a = written(p, "predictions"), written(a, "actuals")
    residuals, gaps = S.residuals(p, a), S.coverage_gaps(p, a)
    for out in (residuals, S.strict_coverage(p, a), S.physical_coverage(p, a), gaps):
        assert "Broadcast" not in plan(out)
    assert sorted(r["error_sec"] for r in residuals.collect()) == [-5, 5]
    assert sorted((r["trip_id"], r["cause"]) for r in gaps.collect()) == [("a", "covered"), ("b", "stop_missing"), ("c", "trip_mismatch"), ("d", "vehicle_absent")]
    assert S.strict_coverage(p, a).first()["n_covered"] == 1 and S.physical_coverage(p, a).first()["n_covered"] == 2
