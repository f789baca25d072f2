import datetime as dt
import random
import time

from pyspark.sql import functions as F

from headway.operators import schedule as SC
from headway.streaming import live, state

FIX = "vehicle_id string, trip_id string, seq long, t double, dist_m double"
ROW = "vehicle_id string, trip_id string, t double, dist_m double, speed double, still_t double, still_dist_m double"


def run(spark, tmp_path, name, fixes, initial=None):
    fixes.coalesce(1).write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(FIX).parquet(str(tmp_path / name))
    out = live.tracked(stream, initial=initial)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    # with timeouts of processing time a query never runs out of batches, so it is stopped once all rows are out and committed
    n, until = fixes.count(), time.time() + 90
    while time.time() < until and (spark.table(name).count() < n or len(q.recentProgress) < 2):
        time.sleep(0.5)
    q.stop()
    return {r["seq"]: (r["progress_speed_mps"], r["stationary_sec"]) for r in spark.table(name).collect()}


def trips(n=120, seed=3):
    pick, out, d = random.Random(seed), [], {}
    for i in range(n):
        v = pick.choice("abc")
        trip = f"{v}{i // 50}"
        d[trip] = d.get(trip, 0.0) + pick.choice([0.0, 3.0, 80.0, 200.0])
        out.append((v, trip, i, 1000.0 + i * pick.choice([2, 8]) + 10 * i, d[trip]))
    return sorted(out, key=lambda r: r[3])


def test_restart_equals_an_unbroken_run(spark, tmp_path):
    rows = trips()
    half = len(rows) // 2
    df = lambda part: spark.createDataFrame(part, FIX)
    whole = run(spark, tmp_path, "whole", df(rows))
    first = run(spark, tmp_path, "first", df(rows[:half]))
    saved = state.saved_state(spark, str(tmp_path / "ck-first"))
    assert saved.count() == 3
    saved.write.parquet(str(tmp_path / "saved"))
    carried = state.aged(spark.read.schema(ROW).parquet(str(tmp_path / "saved")), now=rows[half][3])
    second = run(spark, tmp_path, "second", df(rows[half:]), carried)
    assert {**first, **second} == whole
    cold = run(spark, tmp_path, "cold", df(rows[half:]))
    assert cold != second, "without the state the second half would differ"


def test_rest_ages_and_place_does_not(spark):
    rows = spark.createDataFrame([("a", "t", 100.0, 5.0, 2.0, 50.0, 5.0), ("b", "t", None, None, -1.0, 50.0, 5.0), ("c", "t", 21_000.0, 9.0, 2.0, 20_900.0, 9.0)], ROW)
    got = {r["vehicle_id"]: (r["t"], r["still_t"]) for r in state.aged(rows, now=50.0 + 6 * 3600 + 1).collect()}
    assert got == {"a": (100.0, None), "c": (21_000.0, 20_900.0)}
    assert state.aged(rows, now=50.0 + 6 * 3600).count() == 3


def test_partial_state():
    """Without rest the rest begins now; without a place the speed is unknown."""
    assert live.advance(("t", 100.0, 0.0, 1.0, None, None), "t", 110.0, 50.0)[1:] == (5.0, 0.0)
    assert live.advance(("t", None, None, -1.0, 90.0, 45.0), "t", 110.0, 50.0)[1:] == (-1.0, 20.0)
    assert live.advance(("u", 100.0, 0.0, 1.0, 90.0, 0.0), "t", 110.0, 50.0)[1:] == (-1.0, 0.0)


def test_document_round_trip(spark):
    rows = spark.createDataFrame([("a", "t", 100.0, 5.0, 2.0, 50.0, 5.5), ("b", "u", None, None, -1.0, 50.0, 5.0), ("c", "w", 7.0, 9.25, 2.0, None, None)], ROW)
    again = state.from_document(state.to_document(rows))
    assert sorted(again.drop("speed").collect()) == sorted(rows.drop("speed").collect()) and {r["speed"] for r in again.collect()} == {-1.0}
    bad = ['{"still": {"a": [1, 2, "t"], "b": ["x", 2, "t"], "c": [1], "d": null}, "pos": {"a": [3.5, 4, "t"], "e": [1, 2, "z"], "f": [9, 9, "new"]}}', "not json", "", None]
    texts = spark.createDataFrame([(b,) for b in bad], "content string")
    got = {r["vehicle_id"]: (r["trip_id"], r["t"], r["still_t"]) for r in state.from_document(texts).collect()}
    assert got == {"a": ("t", 3.5, 1.0), "e": ("z", 1.0, None), "f": ("new", 9.0, None)}
    moved = spark.createDataFrame([('{"still": {"a": [1, 2, "old"]}, "pos": {"a": [3, 4, "new"]}}',)], "content string")
    assert [tuple(r)[1:] for r in state.from_document(moved).collect()] == [("new", 3.0, 4.0, -1.0, None, None)]


def test_trips_at_against_brute_force(spark):
    pick = random.Random(2)
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    ways = [(f"t{i}", pick.choice("AB"), pick.choice("xyz")) for i in range(60)]
    times = [(f"t{i}", pick.choice([None, pick.randrange(0, 90_000)]), pick.choice([None, pick.randrange(0, 100_000)])) for i in range(55)]
    services = [(days[0], "x"), (days[1], "x"), (days[1], "y")]
    fixes = [(i, pick.choice("ABC"), pick.choice(days), pick.randrange(86_400)) for i in range(200)]
    got = SC.trips_at(spark.createDataFrame(fixes, "k int, route_id string, day date, now_sec int"), spark.createDataFrame(ways, "trip_id string, route_id string, service_id string"), spark.createDataFrame(services, "day date, service_id string"), spark.createDataFrame(times, "trip_id string, first_sec int, last_sec int"))
    known = {t: (a, b) for t, a, b in times}

    def runs(trip, now):
        a, b = known.get(trip, (None, None))
        return not (a is not None and now < a - 600) and not (b is not None and now > b + 1800)

    want = sorted((k, t) for k, route, day, now in fixes for t, r, s in ways if r == route and (day, s) in services and runs(t, now))
    assert sorted((r["k"], r["trip_id"]) for r in got.collect()) == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and got.where(F.col("k") < 0).count() == 0
