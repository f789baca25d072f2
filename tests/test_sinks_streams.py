import json
import zipfile

from pyspark.sql import functions as F

from headway.operators import features as FE
from headway.operators import serving as SV
from headway.operators import trajectory as T
from headway.plans import testbed as B
from headway.sources import sinks
from headway.sources import snapshots as SN
from headway.streaming import live

SF = "/root/testdata/sf0.001"


def test_days_are_written_once(spark, tmp_path):
    at = str(tmp_path / "days")
    rows = lambda *days, v=1: spark.createDataFrame([(d, v) for d in days], "date string, v int")
    assert [r["date"] for r in sinks.write_days(rows("2024-01-01", "2024-01-02"), at).collect()] != []
    assert [r["date"] for r in sinks.write_days(rows("2024-01-02", "2024-01-03", v=2), at).collect()] == ["2024-01-03"]
    assert {(str(r["date"]), r["v"]) for r in spark.read.parquet(at).collect()} == {("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 2)}
    sinks.write_days(rows("2024-01-02", v=3), at, again=True)
    assert {(str(r["date"]), r["v"]) for r in spark.read.parquet(at).collect()} == {("2024-01-01", 1), ("2024-01-02", 3), ("2024-01-03", 2)}


def test_columns_reports_and_status(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 5), ("2024-01-02", 7)], "date string, n int")
    rows.write.parquet(str(tmp_path / "old"))
    assert sinks.add_column(str(tmp_path / "old"), str(tmp_path / "new"), spark, "s", 0.0, "double")
    assert not sinks.add_column(str(tmp_path / "new"), str(tmp_path / "newer"), spark, "s", 0.0, "double")
    sinks.write_report(rows, str(tmp_path / "quality"))
    assert spark.read.json(str(tmp_path / "quality/latest")).first()["n"] == 7
    assert spark.read.json(str(tmp_path / "quality/days")).count() == 2
    sinks.write_events(rows, str(tmp_path / "csv"))
    assert FE.capped_sample(SN.feature_table(spark, str(tmp_path / "csv")), 10).count() == 2
    sinks.write_evaluation(rows, rows.agg(F.avg("n").alias("mae")), str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/metrics")).first()["mae"] == 6
    sinks.status_writer(str(tmp_path / "status"), ("date",))(rows, 3)
    text = next((tmp_path / "status").glob("*.json")).read_text()
    assert json.loads(text) == {"n": 2, "date": "2024-01-02", "batch": 3}
    sinks.status_writer("/proc/none")(rows, 4)  # says so and goes on


def test_schedule_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name in ("stop_times", "trips", "routes", "stops"):
            z.writestr(f"{name}.txt", "﻿a,b\n01,2\n")
        z.writestr("agency.txt", "agency_id,agency_timezone\n1,Europe/Kyiv\n")
    tables = SN.schedule_zip(spark, str(tmp_path / "feed.zip"), str(tmp_path / "tables"))
    assert tables["trips"].first()["a"] == "01" and SN.agency_timezone(tables["agency"]) == "Europe/Kyiv"
    assert SN.agency_timezone(spark.createDataFrame([("No/Where",)], "agency_timezone string")) == "UTC"
    assert SN.agency_timezone(spark.createDataFrame([("1",)], "agency_id string")) == "UTC"


def test_schedule_archive_keeps_records_and_their_order(spark, tmp_path):
    """Many blocks of one member, with line feeds, separators and quotes within fields, and Windows line ends."""
    rows = [(f"{i:05d}", f'a "{i}"\nsecond, line\u2028of {i}' if i % 3 == 0 else f"plain {i}") for i in range(3000)]
    text = 'stop_id,stop_name\r\n' + "".join('{},"{}"\r\n'.format(k, v.replace('"', '""').replace("\n", "\r\n")) for k, v in rows)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name in ("stop_times", "trips", "routes"):
            z.writestr(f"{name}.txt", "a,b\n01,2\n")
        z.writestr("inner/stops.txt", text)
    tables = SN.schedule_zip(spark, str(tmp_path / "feed.zip"), str(tmp_path / "tables"), block=500)
    assert tables["stops"].columns == ["stop_id", "stop_name"]
    assert [tuple(r) for r in tables["stops"].collect()] == rows


def test_positions_in_order(spark):
    rows = spark.createDataFrame([(20, "b"), (10, "z"), (20, "a")], "feed_ts long, vehicle_id string")
    assert [tuple(r) for r in SN.in_order(rows).select("feed_ts", "vehicle_id").collect()] == [(10, "z"), (20, "a"), (20, "b")]


def test_live_status_equals_batch(spark, tmp_path):
    fixes = B.fixes(spark, SF).withColumn("bearing_diff", F.abs(F.col("bearing") - 180)).select("vehicle_id", "trip_id", "seq", "t", "off_m", "bearing_diff").coalesce(1)
    fixes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fixes.schema).parquet(str(tmp_path / "in"))
    q = live.off_route(stream).writeStream.format("memory").queryName("off_route").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: r["off_route"] for r in spark.table("off_route").collect()}
    want = {r["seq"]: r["off_route"] for r in T.off_route_status(fixes, keys=("vehicle_id", "trip_id")).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_once_each_archive_and_serve(spark, tmp_path):
    rows = spark.createDataFrame([("v", "2024-01-01 00:00:00"), ("v", "2024-01-01 00:00:00"), ("w", "2024-01-01 00:00:00")], "vehicle_id string, ts string").select("vehicle_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    q = live.serve(live.once_each(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), lambda batch, n: seen.extend(r["vehicle_id"] for r in batch.collect()), str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination(120)
    assert sorted(seen) == ["v", "w"]
    feeds = spark.createDataFrame([(10, b"a"), (299, b"b"), (300, b"c")], "feed_ts long, content binary")
    assert sorted(r["feed_ts"] for r in live.archive(feeds).collect()) == [10, 300]


def test_stops_ahead_of_a_vehicle(spark):
    """Known case: at 995 m of stops every 500 m the next stop is 5 m ahead; without a table the dwell is 15 s."""
    stops = spark.createDataFrame([("t", f"stop{i}", i + 1, i * 500.0, i * 60.0) for i in range(5)], "trip_id string, stop_id string, stop_sequence int, stop_dist_m double, cum_sec double")
    at = spark.createDataFrame([("v", "t", 995.0, "2024-01-01"), ("w", "t", 250.0, "2024-01-01"), ("x", "none", 0.0, "2024-01-01")], "vehicle_id string, trip_id string, dist_m double, service_date string")
    rows = SV.serving_features(at, stops, spark.createDataFrame([("t", 2000.0)], "trip_id string, length_m double")).orderBy("vehicle_id", "stops_ahead").collect()
    first = rows[0]
    assert (first["stop_id"], first["stop_sequence"], first["remaining_dist_m"], first["stops_remaining"], first["is_holiday"]) == ("stop2", 3, 5.0, 2, 1)
    assert [r["sched_remaining_sec"] for r in rows if r["vehicle_id"] == "w"][:2] == [30.0, 90.0] and {r["vehicle_id"] for r in rows} == {"v", "w"}
    none = spark.createDataFrame([], "route_type string, dwell_sec double")
    assert SV.with_dwell(spark.createDataFrame([(3,)], "route_type int"), none).first()["dwell_sec"] == 15
