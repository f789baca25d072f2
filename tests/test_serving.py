import datetime as dt

from pyspark.sql import functions as F

from headway.functions import clock, geo, serving
from headway.operators import calibration as C
from headway.operators import features as FE
from headway.operators import quality as Q
from headway.operators import scoring as S
from headway.operators import shapes as SH
from headway.sources import wire
from headway.streaming.live import advance


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_isotonic_and_arrivals(spark):
    a = F.array(*map(F.lit, (120.0, 100.0, 300.0)))
    assert one(spark, serving.isotonic(a)) == [[110, 110, 300]]
    assert one(spark, serving.isotonic(F.array(F.lit(1.0), F.lit(2.0)))) == [[1, 2]]
    assert one(spark, serving.arrival_times(F.lit(1000), F.array(F.lit(-300.0), F.lit(400.0)))) == [[1001, 1400]]


def test_horizon_table(spark):
    t = F.create_map(*map(F.lit, (1, 20, 2, 35, 3, 60)))
    assert one(spark, *(serving.horizon_value(t, F.lit(h)) for h in (1, 3, 9, 0))) == [20, 60, 60, None]


def test_clock(spark):
    assert one(spark, *(clock.service_seconds(F.lit(x)) for x in ("24:10:00", "1:2:3", "10:00", "a:b:c", ""))) == [87000, 3723, None, None, None]
    assert one(spark, clock.until_departure(F.lit(85_800), F.lit(300), F.lit(0)), clock.until_departure(F.lit(87_000), F.lit(300), F.lit(11)), clock.until_departure(F.lit(87_000), F.lit(300), F.lit(3))) == [None, 300, None]
    assert one(spark, clock.service_text(F.lit(87_000))) == ["24:10:00"]


def test_sources_of_predictions(spark):
    src = lambda s, d, o, f, u: serving.prediction_source(F.lit(s), F.lit(d), F.lit(o), F.lit(f), F.lit(u).cast("int"))
    assert one(spark, src(0.0, 5.0, 3.0, 0.0, 360), src(0.0, 5.0, 3.0, 400.0, 360), src(0.0, 5.0, 3.0, 0.0, None), src(8.0, 5.0, 3.0, 0.0, 360)) == ["schedule", "withheld", "idle", "model"]


def test_shapes(spark):
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 1000.0, 0.0), ("s", 2, 1000.0, 1.0), ("s", 3, 0.0, 1.0)], "shape_id string, seq int, x double, y double")
    segs = SH.segments(pts)
    p = spark.createDataFrame([(1, "s", 500.0, 0.5, 500.0), (2, "s", 500.0, 0.5, 1501.0), (3, "s", 500.0, 0.5, None)], "k int, shape_id string, x double, y double, expected_m double")
    got = {r["k"]: round(r["along_m"]) for r in SH.project_near(p, segs, ["k"]).collect()}
    assert got == {1: 500, 2: 1501, 3: 500}
    assert {round(r["tangent"]) for r in SH.project(p.limit(1), segs, ["k"]).collect()} == {90}
    assert round(SH.lengths(segs).first()["length_m"]) == 2001
    assert one(spark, geo.bearing_diff(F.lit(350.0), F.lit(20.0)), geo.bearing(F.lit(-1.0), F.lit(0.0))) == [30, 270]


def test_scoring(spark):
    p = spark.createDataFrame([(1010, "v", "t", "r", "s", 1, 1, 1120), (1200, "v", "t", "r", "s", 1, 1, 1190)], "feed_ts long, vehicle_id string, trip_id string, route_id string, stop_id string, stop_sequence int, stops_ahead int, predicted_arrival long")
    a = spark.createDataFrame([("v", "t", "r", "s", 1, 1100), ("v", "t", "r", "s2", 2, 9000), ("w", "t", "r", "s", 1, 1100)], "vehicle_id string, trip_id string, route_id string, stop_id string, stop_sequence int, actual_arrival_ts long")
    kept = S.residuals(p, a).where("kept").collect()
    assert [(r["error_sec"], r["lead_sec"], r["lead_bucket"]) for r in kept] == [(20, 110, "0-2m")]
    assert sorted(r["cause"] for r in S.coverage_gaps(p, a).collect()) == ["covered", "stop_missing", "vehicle_absent"]


def test_calibration(spark):
    daily = spark.createDataFrame([("2024-01-01", 1, 100, 100.0, 5.0, "ok"), ("2024-01-02", 1, 300, 200.0, 9.0, "ok"), ("2024-01-02", 2, 300, 150.0, 9.0, "ok")], "date string, stops_ahead int, n long, mae_sec double, bias_sec double, status string")
    assert {r["stops_ahead"]: r["mae_sec"] for r in C.pooled_mae(daily).collect()} == {1: 175, 2: 175}
    live = spark.createDataFrame([(1, 18.0), (2, 14.0)], "stops_ahead int, bias_sec double")
    residual = spark.createDataFrame([(1, 34.2), (2, 31.3), (3, 4.0)], "stops_ahead int, bias_sec double")
    assert {r["stops_ahead"]: r["bias_sec"] for r in C.accumulate_bias(live, residual).collect()} == {1: 35, 2: 30, 3: 2}


def test_new_routes_reach_training(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(d), "OLD" if d < 20 else "NEW", f"v{k}", "t", k, 1) for d in range(22) for k in range(40)] + [(day + dt.timedelta(21), "OLD", "x", "t", 1, 1)]
    split = FE.time_split(spark.createDataFrame(rows, "service_date date, route_id string, vehicle_id string, trip_id string, seq long, stop_sequence int"), share=0.91)
    n = {(r["route_id"], r["is_train"]): r["n"] for r in split.groupBy("route_id", "is_train").agg(F.count("*").alias("n")).collect()}
    assert n["OLD", True] == 800 and n["OLD", False] == 1 and n["NEW", True] > n["NEW", False] > 0


def test_collapse_guard(spark):
    p = spark.createDataFrame([(1, 500), (2, 5), (3, 480), (4, 150)], "pass_no long, n_entities long")
    assert [r["published"] for r in Q.collapse_guard(p).orderBy("pass_no").collect()] == [True, False, True, True]


def test_staleness(spark):
    feeds = [(1000, 998), (1000, 940), (5000, 4456), (5000, 4400), (9000, 7000)]
    got = {(r["feed_ts"], r["fix_ts"]): (r["reference_ts"], r["is_stale"]) for r in Q.staleness(spark.createDataFrame(feeds, "feed_ts long, fix_ts long")).collect()}
    assert got == {(1000, 998): (1000, False), (1000, 940): (1000, False), (5000, 4456): (4456, False), (5000, 4400): (4456, False), (9000, 7000): (9000, True)}


def test_live_state():
    state, out = None, []
    for trip, d, t in (("a", 100, 1000), ("a", 250, 1015), ("a", 250, 1015), ("b", 50, 1030), ("b", 500, 2000)):
        state, speed, _ = advance(state, trip, t, d)
        out.append(speed)
    assert out == [-1, 10, 10, -1, -1]
    state, out = None, []
    for trip, d, t in (("a", 100, 1000), ("a", 105, 1060), ("a", 118, 1300), ("a", 400, 1330), ("a", 402, 1390), ("b", 402, 1400)):
        state, _, still = advance(state, trip, t, d)
        out.append(still)
    assert out == [0, 60, 300, 0, 60, 0]


def test_wire_round_trip():
    row = {"vehicle_id": "v1", "trip_id": "t1", "route_id": "A25", "lat": 49.5, "lon": 24.0, "bearing": None, "speed": 3.5, "stop_id": None, "current_status": 2, "vehicle_ts": 1_700_000_000}
    data = wire.encode_feed(1_700_000_005, [wire.encode_vehicle(row)])
    assert wire.decode_vehicles(data) == [(1_700_000_005, "v1", "t1", "A25", 49.5, 24.0, 0.0, 3.5, None, 2, 1_700_000_000)]
    assert wire.decode_vehicles(data, "null")[0][6] is None
    update = {"vehicle_id": "v1", "trip_id": "t1", "route_id": "A25", "stops": [{"stop_id": "s1", "stop_sequence": 1, "arrival": 1_700_000_100}, {"stop_id": "s2", "stop_sequence": 2}, {"stop_id": "s1", "stop_sequence": 3, "arrival": 1_700_000_300}]}
    data = wire.encode_feed(1_700_000_005, [wire.encode_trip_update(update)])
    assert [(r[4], r[6], r[7]) for r in wire.decode_predictions(data)] == [("s1", 1, 1_700_000_100), ("s1", 3, 1_700_000_300)]
    assert wire.feed_stats(data, "s1") == (1_700_000_005, 1, 2)


def test_scheduled_seconds_agree_in_training_and_serving(spark):
    """Both builders read the same schedule at the same places: 30 and 90 seconds from between two stops."""
    from headway.operators import serving as SV

    stops = spark.createDataFrame([("t", f"s{i}", i + 1, i * 500.0, i * 60.0) for i in range(5)], "trip_id string, stop_id string, stop_sequence int, stop_dist_m double, cum_sec double")
    fixes = spark.createDataFrame([("v", "t", 1, 250.0, dt.date(2024, 1, 3), 7), ("v", "t", 2, 1999.0, dt.date(2024, 1, 3), 7)], "vehicle_id string, trip_id string, seq long, dist_m double, service_date date, hour int")
    served = SV.serving_features(fixes, stops, spark.createDataFrame([("t", 2000.0)], "trip_id string, length_m double"))
    profile = stops.select("trip_id", F.col("stop_dist_m").alias("dist_m"), "cum_sec")
    trained = FE.scheduled_remaining(served.select("seq", "trip_id", "dist_m", "stop_sequence", "stop_dist_m"), profile)
    key = lambda r: (r["seq"], r["stop_sequence"])
    got = {key(r): round(r["sched_remaining_sec"], 6) for r in trained.collect()}
    assert got == {key(r): round(r["sched_remaining_sec"], 6) for r in served.collect()}
    assert [got[1, s] for s in (2, 3)] == [30, 90] and got[2, 5] == 0.12
    assert [r["sched_remaining_sec"] for r in FE.scheduled_remaining(served.limit(1).select("trip_id", "dist_m", "stop_dist_m"), profile.limit(1)).collect()] == [None]
