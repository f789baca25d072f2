import numpy as np
from pyspark.sql import functions as F

from headway.models import trees
from headway.operators import features as FE
from headway.operators import trajectory as T
from headway.plans import testbed as B
from headway.sources import snapshots as SN
from headway.sources import wire
from headway.streaming import live

SF = "/root/testdata/sf0.001"


def test_snapshot_files(spark, tmp_path):
    for name, ts in (("20240101T000000Z", 1704067200), ("20240101T000100Z", 1704067260), ("latest", 5)):
        (tmp_path / f"{name}.pb").write_bytes(wire.encode_feed(ts, [wire.encode_vehicle({"vehicle_id": "v", "trip_id": "t", "lat": 1.5, "lon": 2.5})]))
    (tmp_path / "20240101T000200Z.pb").write_bytes(b"\x0a\xff")
    (tmp_path / "20240101T000300Z.pb").write_bytes(b"")
    files = SN.snapshot_files(spark, str(tmp_path), "2024-01-01 00:00:30", "2024-01-01 00:05:00")
    assert files.count() == 2  # Spark leaves out the empty object
    assert [(r["feed_ts"], r["vehicle_id"], r["lat"]) for r in SN.vehicle_positions(files).collect()] == [(1704067260, "v", 1.5)]
    assert SN.snapshot_files(spark, str(tmp_path)).count() == 4
    try:
        SN.vehicle_positions(files, mode="FAILFAST").collect()
        raise AssertionError("a broken object must fail")
    except Exception as e:
        assert "truncated" in str(e)


def test_feeds_round_trip(spark):
    rows = spark.createDataFrame([(10, f"v{i}", f"t{i}", "r", 49.5, 24.25, 90.0, 3.0, "s", 2, 9) for i in range(5)], wire.VEHICLES)
    again = SN.vehicle_positions(SN.encoded_feeds(rows)).drop("timestamp")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_schedule_tables(spark, tmp_path):
    for name in ("stop_times", "trips", "routes", "stops"):
        (tmp_path / f"{name}.txt").write_text("a,b\n01,2\n")
    tables = SN.schedule_tables(spark, str(tmp_path))
    assert set(tables) == {"stop_times", "trips", "routes", "stops"} and tables["trips"].first()["a"] == "01"


def test_stream_equals_batch(spark, tmp_path):
    fixes = B.fixes(spark, SF).select("vehicle_id", "trip_id", "seq", "t", "dist_m").orderBy("t").coalesce(1)
    fixes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "in"))
    q = live.tracked(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: (r["progress_speed_mps"], r["stationary_sec"]) for r in spark.table("tracked").collect()}
    want = {}
    for r in fixes.orderBy("vehicle_id", "t", "seq").collect():
        state = want.get(("state", r["vehicle_id"]))
        state, speed, still = live.advance(state, r["trip_id"], r["t"], r["dist_m"])
        want["state", r["vehicle_id"]] = state
        want[r["seq"]] = (speed, still)
    assert got == {k: v for k, v in want.items() if not isinstance(k, tuple)}


def test_trees(spark):
    f = T.with_stationary(T.progress_speed(B.fixes(spark, SF)))
    rows = T.training_rows(f, B.stops(f), horizon=B.HORIZON_SEC)
    lengths = B.stops(f).groupBy("trip_id").agg(F.max("stop_dist_m").alias("length_m"))
    rows = FE.progress_features(FE.calendar_features(FE.apply_priors(rows, FE.route_hour_priors(rows))), lengths)
    rows = FE.with_codes(rows, FE.ordinal_codes(rows)).cache()
    model = trees.fit(rows, maxIter=8, maxDepth=4)
    scored = model.transform(rows)
    base = rows.agg(F.expr("percentile(seconds_to_arrival, 0.5)")).first()[0]
    flat = rows.agg(F.avg(F.abs(F.col("seconds_to_arrival") - base))).first()[0]
    assert trees.mean_absolute_error(scored) < flat
    by = {r["name"]: r["mae_sec"] for r in trees.improvement(scored, ["speed_eta_warm"]).collect()}
    assert set(by) == {"predicted", "speed_eta_warm"}
    again = trees.score_trees(scored.withColumnRenamed("predicted", "mllib"), trees.node_table(model)).select("mllib", "predicted").toPandas()
    assert np.allclose(again["mllib"], again["predicted"])
