import datetime as dt
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.models import boosting as BO
from headway.operators import features as FE
from headway.operators import serving as SV
from headway.operators import trajectory as T
from headway.plans import source_queries as Q
from headway.plans import testbed as B
from headway.sources import bundle as BU

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 9)
TREES = [[(0, 5.0, 1, 2, False, 0.0), (0, 0.0, 0, 0, True, -1.5), (1, 0.25, 3, 4, False, 0.0), (0, 0.0, 0, 0, True, 2.0), (0, 0.0, 0, 0, True, 8.0)], [(0, 0.0, 0, 0, True, 0.5)]]


def small(spark, value=1):
    return {**BU.model_tables(spark, TREES, 10.0, ("a", "b")), "dwell": spark.createDataFrame([("0", 30.0), (None, float(value))], "route_type string, dwell_sec double")}


def test_digest_is_of_the_rows_alone(spark):
    rows = [(i % 7, None if i % 5 == 0 else i / 3, f"k{i}", dt.datetime(2024, 1, 1, 0, 0, 0, i)) for i in range(200)]
    table = spark.createDataFrame(rows, "a int, b double, c string, at timestamp")
    same = BU.table_digest(table)
    for other in (table.repartition(7), table.orderBy(F.desc("c")), table.select("c", "at", "b", "a")):
        assert BU.table_digest(other) == same
    for other in (table.unionByName(table.limit(1)), table.where("c <> 'k3'"), table.withColumn("a", F.col("a").cast("long")), table.withColumnRenamed("c", "d"), table.withColumn("at", F.col("at") + F.expr("INTERVAL 1 MICROSECOND")), table.withColumn("b", F.coalesce("b", F.lit(0.0)))):
        assert BU.table_digest(other)[1] != same[1]
    twice = table.unionByName(table)
    assert BU.table_digest(twice)[1] not in (same[1], BU.table_digest(table.limit(0))[1]), "a row that is there twice doesn't cancel out"


def test_model_round_trip(spark):
    assert BU.model_of(BU.model_tables(spark, TREES, 10.0, ("a", "b"))) == (TREES, 10.0, ("a", "b"))
    assert BU.model_of(BU.model_tables(spark, [], 3.0, ())) == ([], 3.0, ())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(BU.MixedBundle, match="no finished version"):
        BU.read_bundle(spark, path)
    first = BU.write_bundle(spark, path, "1", small(spark), DAY)
    assert first.model_since == "2024-01-09" and set(first.tables) == {"trees", "model", "dwell"}
    # the same trees exported again with another table: another bundle, the same model
    second = BU.write_bundle(spark, path, "2", {k: v.repartition(3) for k, v in small(spark, 2).items()}, DAY + dt.timedelta(3))
    assert second.digest != first.digest and (second.fingerprint, second.model_since) == (first.fingerprint, "2024-01-09")
    third = BU.write_bundle(spark, path, "3", {**small(spark), **BU.model_tables(spark, TREES[:1], 10.0, ("a", "b"))}, DAY + dt.timedelta(5))
    assert third.fingerprint != first.fingerprint and third.model_since == "2024-01-14"
    assert BU.versions(spark, path) == ["1", "2", "3"] and BU.read_bundle(spark, path).version == "3"
    # a finished version stays: repeated it is no work, with other tables it is refused
    assert BU.write_bundle(spark, path, "1", small(spark), DAY + dt.timedelta(9)).model_since == "2024-01-09"
    with pytest.raises(BU.MixedBundle, match="other tables"):
        BU.write_bundle(spark, path, "1", small(spark, 3), DAY)


def test_mixed_sets_are_refused(spark, tmp_path):
    path = str(tmp_path / "b")
    for v in ("1", "2"):
        BU.write_bundle(spark, path, v, small(spark, int(v)), DAY)
    at = lambda v, name: f"{path}/version={v}/{name}"
    shutil.rmtree(at("2", "dwell"))
    with pytest.raises(BU.MixedBundle, match="dwell"):
        BU.read_bundle(spark, path, "2")
    shutil.copytree(at("1", "dwell"), at("2", "dwell"))
    with pytest.raises(BU.MixedBundle, match="other dwell"):
        BU.read_bundle(spark, path, "2")
    shutil.rmtree(at("2", "manifest"))
    with pytest.raises(BU.MixedBundle, match="to its end"):
        BU.read_bundle(spark, path, "2")
    assert BU.read_bundle(spark, path).version == "1"  # what isn't finished isn't seen
    assert BU.write_bundle(spark, path, "2", small(spark, 2), DAY).version == "2"  # and can be written again
    shutil.rmtree(at("1", "manifest"))
    shutil.copytree(at("2", "manifest"), at("1", "manifest"))
    with pytest.raises(BU.MixedBundle, match="several"):
        BU.read_bundle(spark, path, "1")
    with pytest.raises(ValueError):
        BU.write_bundle(spark, path, "3", {}, DAY)


def test_serving_needs_its_tables(spark, tmp_path):
    bundle = BU.write_bundle(spark, str(tmp_path / "b"), "1", small(spark), DAY)
    with pytest.raises(BU.MixedBundle, match="priors, codes, bias"):
        bundle.serve(spark.range(1))


@pytest.fixture(scope="module")
def learnt(spark):
    """Vehicles, training rows with all inputs, and the tables behind them."""
    vehicles, tables = Q.vehicles(spark, SF), Q.serving_tables(spark, SF)
    rows = T.training_rows(vehicles, tables["stops"].drop("cum_sec"), horizon=B.HORIZON_SEC)
    rows = FE.progress_features(FE.calendar_features(FE.apply_priors(rows, tables["priors"])), tables["lengths"])
    return vehicles, FE.with_codes(rows, tables["codes"]).cache(), tables


def test_served_rows_equal_training_rows(spark, learnt):
    """Of the same fix and stop, every input is the same, as the model knows inputs by their place only."""
    vehicles, trained, t = learnt
    served = SV.served_vector(vehicles, t["stops"], t["lengths"], t["priors"], t["codes"])
    keys = ["vehicle_id", "trip_id", "seq", "stop_sequence"]
    names = ["route_code", *(c for c in FE.FEATURES if c not in keys)]
    both = trained.select(*keys, *(F.col(c).alias(f"t_{c}") for c in names)).join(served.select(*keys, *names), keys)
    assert both.count() == trained.count() > 1000, "what was learnt from is served"
    pdf = both.toPandas()
    for c in names:
        got, want = pdf[c], pdf[f"t_{c}"]
        assert np.allclose(got.astype(float), want.astype(float)) if c != "route_id" else (got == want).all(), c


def test_unknown_speed_and_rest(spark, learnt):
    vehicles, _, t = learnt
    bare = SV.served_vector(vehicles.drop("progress_speed_mps", "stationary_sec"), t["stops"], t["lengths"], t["priors"], t["codes"])
    null = SV.served_vector(vehicles.withColumns({"progress_speed_mps": F.lit(None).cast("double"), "stationary_sec": F.lit(None).cast("double")}), t["stops"], t["lengths"], t["priors"], t["codes"])
    assert {tuple(r) for r in bare.select("progress_speed_mps", "stationary_sec").distinct().collect()} == {(-1.0, 0.0)}
    assert bare.exceptAll(null.select(*bare.columns)).isEmpty()
    assert bare.where("speed_eta_warm IS NULL OR hist_travel_time_est IS NULL").isEmpty()


def test_exported_model_predicts_the_same(spark, learnt, tmp_path):
    vehicles, trained, tables = learnt
    model = BO.boost(BO.with_validation_days(trained, share=0.2), max_iter=4, depth=3, step=0.5)
    assert model.trees
    served = model.score(SV.served_vector(vehicles, tables["stops"], tables["lengths"], tables["priors"], tables["codes"])).select("seq", "stop_sequence", F.col("predicted").alias("direct"))
    bundle = BU.write_bundle(spark, str(tmp_path / "b"), "1", {**tables, **BU.model_tables(spark, model.trees, model.baseline, model.columns)}, DAY)
    both = bundle.serve(vehicles).select("seq", "stop_sequence", "predicted", "bias_sec", "seconds").join(served, ["seq", "stop_sequence"]).toPandas()
    assert len(both) == served.count() and np.array_equal(both["predicted"], both["direct"])
    assert np.allclose(both["seconds"], both["predicted"] - both["bias_sec"]) and both["bias_sec"].nunique() > 2
