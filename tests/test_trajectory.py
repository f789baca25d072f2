import pytest
from pyspark.sql import functions as F

from headway.operators import trajectory as T

COLS = "vehicle_id string, trip_id string, route_id string, seq long, t double, dist_m double"


def fixes(spark, dists, step=30.0, times=None):
    times = times or [i * step for i in range(len(dists))]
    return spark.createDataFrame([("v1", "t1", "A25", i, float(t), float(d)) for i, (t, d) in enumerate(zip(times, dists, strict=True))], COLS)


def stops(spark, n=5, spacing=500.0):
    return spark.createDataFrame([("t1", f"stop{i}", i + 1, i * spacing) for i in range(n)], "trip_id string, stop_id string, stop_sequence int, stop_dist_m double")


def ordered(df, col):
    return [r[col] for r in df.orderBy("seq").collect()]


def test_stationary_anchor(spark):
    assert ordered(T.stationary_seconds(fixes(spark, [0, 5, 12, 300, 305, 310, 900])), "stationary_sec") == [0, 30, 60, 0, 30, 60, 0]


def test_progress_speed(spark):
    f = fixes(spark, [0, 300, 600, 560, 1500], times=[0, 30, 60, 90, 300])
    assert ordered(T.progress_speed(f), "progress_speed_mps") == [-1, 10, 10, -1, -1]


def test_constant_speed_targets(spark):
    f = T.progress_speed(fixes(spark, [i * 300 for i in range(9)]))
    rows = T.training_rows(f, stops(spark)).collect()
    assert rows and all(abs(r["seconds_to_arrival"] - (r["stop_dist_m"] - r["dist_m"]) / 10) < 3 for r in rows)
    assert min(r["stops_ahead"] for r in rows) == 1 and max(r["stops_ahead"] for r in rows) <= 10


def test_dwell_shows_in_targets(spark):
    f = T.progress_speed(fixes(spark, [0, 300, 600, 900, 998, 998, 998, 1100, 1400, 1700, 2000]))
    near = [r["seconds_to_arrival"] for r in T.training_rows(f, stops(spark)).collect() if 0 < r["stop_dist_m"] - r["dist_m"] <= 5]
    assert min(near) < 5 and max(near) > 30


def test_horizon_breaks_the_list(spark):
    f = T.progress_speed(fixes(spark, [0, 400, 401, 2500], times=[0, 30, 5000, 5030]))
    rows = T.training_rows(f, stops(spark)).where("seq = 0").collect()
    assert rows == []


def test_constrained_progress(spark):
    out = ordered(T.constrained_progress(fixes(spark, [0, 100, 5000, 200, 6000, 6100], step=10)), "dist_m")
    assert out == [0, 100, 500, 500, 6000, 6100]


def test_off_route_fold(spark):
    off = [10, 200, 200, 200, 90, 90, 90, 10]
    f = fixes(spark, [0] * 8).withColumn("off_m", F.element_at(F.array(*map(F.lit, map(float, off))), (F.col("seq") + 1).cast("int"))).withColumn("bearing_diff", F.lit(None).cast("double"))
    s = T.off_route_status(f)
    assert ordered(s, "off_route") == [False, False, False, True, True, True, False, False]
    e = T.off_route_episodes(s).collect()
    assert len(e) == 1 and e[0]["off_start"] == 90 and e[0]["off_end"] == 180 and e[0]["duration_min"] == pytest.approx(1.5)


def test_dwell_events(spark):
    f = fixes(spark, [0, 300, 495, 496, 497, 700, 900], step=20)
    assert [r["dwell_sec"] for r in T.dwell_events(f, stops(spark)).collect()] == [60.0]
