import os

import pytest

from headway.sources import snapshot_source as SS
from headway.sources import snapshots as SN
from headway.sources import wire

HOUR = 3600
START = 1_704_067_200  # 2024-01-01 00:00 UTC


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three days of hourly objects, written through the source, and some that are broken, unnamed or empty."""
    path = str(tmp_path_factory.mktemp("objects") / "raw")
    rows = [(START + h * HOUR, f"v{i}", f"t{h % 5}", "r", 49.5, 24.25, 90.0, 3.0, "s", 2, START + h * HOUR - 5) for h in range(72) for i in range(3)]
    SS.write_snapshots(SN.encoded_feeds(spark.createDataFrame(rows, wire.VEHICLES)), path)
    day = f"{path}/date=2024-01-02"
    for name, data in (("20240102T003000Z", b"\x0a\xff"), ("20240102T004500Z", b""), ("latest", wire.encode_feed(5, [wire.encode_vehicle({"vehicle_id": "x"})]))):
        with open(f"{day}/{name}.pb", "wb") as f:
            f.write(data)
    return path, rows


def opened(path, **options):
    reader = SS.SnapshotReader({"path": path, **options})
    return reader, lambda: [p for part in reader.partitions() for p, _ in part.objects]


def test_round_trip_and_whole_read(spark, folder):
    path, rows = folder
    assert len(os.listdir(path)) == 3 and not [f for _, _, names in os.walk(path) for f in names if f.startswith("_")]
    got = SS.read_snapshots(spark, path).where("vehicle_id <> 'x'").drop("path", "key_ts")
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_filter_equals_the_binary_file_reader(spark, folder):
    path, _ = folder
    for bounds in (("2024-01-01 22:30:00", "2024-01-02 01:00:00"), ("2024-01-03 00:00:00", None), (None, "2024-01-01 00:00:00"), (None, None)):
        want = SN.vehicle_positions(SN.snapshot_files(spark, path, *bounds)).drop("timestamp")
        got = SS.read_snapshots(spark, path, *bounds).drop("path", "key_ts")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), bounds


def test_filter_opens_only_its_objects(spark, folder):
    """Everything out of range is broken here, and fails the job if it is opened."""
    path, _ = folder
    held = {f"{d}/{f}": open(f"{d}/{f}", "rb").read() for d, _, names in os.walk(path) for f in names if not f.startswith(("20240102T05", "20240102T06", "20240102T07"))}
    try:
        for f in held:
            with open(f, "wb") as out:
                out.write(b"\x0a\xff")
        with pytest.raises(Exception, match="truncated"):
            SS.read_snapshots(spark, path, mode="FAILFAST").count()
        assert SS.read_snapshots(spark, path, "2024-01-02 05:00:00", "2024-01-02 06:00:00", mode="FAILFAST").count() == 6
        for condition, n in (("key_ts = TIMESTAMP '2024-01-02 05:00:00'", 3), ("key_ts > TIMESTAMP '2024-01-02 05:00:00' AND key_ts < TIMESTAMP '2024-01-02 07:00:00'", 3)):
            assert SS.read_snapshots(spark, path, mode="FAILFAST").where(condition).count() == n
    finally:
        for f, data in held.items():
            with open(f, "wb") as out:
                out.write(data)


def test_pushed_bounds_choose_the_objects(folder):
    path, _ = folder
    reader, paths = opened(path)
    assert len(paths()) == 75
    bound = lambda text: SS.instant_of(text)
    left = list(reader.pushFilters([SS.IsNotNull(("key_ts",)), SS.GreaterThanOrEqual(("key_ts",), bound("20240102T050000Z")), SS.LessThan(("key_ts",), bound("20240102T070000Z")), SS.EqualTo(("vehicle_id",), "v1")]))
    assert len(left) == 4  # all are left to Spark too
    assert [p.rsplit("/", 1)[1] for p in paths()] == ["20240102T050000Z.pb", "20240102T060000Z.pb", "20240102T070000Z.pb"]
    reader, paths = opened(path)
    assert len(list(reader.pushFilters([SS.IsNotNull(("key_ts",))]))) == 1 and len(paths()) == 74  # no object without a time


def test_partitions_are_ranges_of_time(folder):
    path, _ = folder
    reader, _ = opened(path, partitionbytes="500")
    parts = [[at for _, at in p.objects if at] for p in reader.partitions()]
    assert len(parts) > 10 and [at for p in parts for at in p] == sorted(at for p in parts for at in p)


def test_broken_objects(spark, folder):
    path, _ = folder
    with pytest.raises(Exception, match="truncated"):
        SS.read_snapshots(spark, path, mode="FAILFAST").count()
    objects = SS.read_snapshots(spark, path, kind="objects")
    assert objects.count() == 75 and objects.where("key_ts IS NULL").count() == 1


def test_empty_folder_and_names(spark, tmp_path):
    assert SS.read_snapshots(spark, str(tmp_path)).count() == 0
    assert SS.instant_of("2024-01-02T05:00:00+02:00.pb") == SS.instant_of("20240102T030000Z.pb") and SS.instant_of("latest.pb") is None
    assert str(SS.day_of("date=2024-01-02")) == "2024-01-02" == str(SS.day_of("2024-01-02")) and SS.day_of("date=2024-13-02") is None and SS.day_of("raw") is None


def test_rewriting_replaces_and_overwrite_is_refused(spark, tmp_path):
    feeds = spark.createDataFrame([(START, b"a"), (None, b"b"), (START + 1, None)], "feed_ts long, content binary")
    for _ in range(2):
        SS.write_snapshots(feeds, str(tmp_path / "o"))
    assert [bytes(r["content"]) for r in SS.read_snapshots(spark, str(tmp_path / "o"), kind="objects").collect()] == [b"a"]
    with pytest.raises(Exception, match="appended"):
        feeds.write.format(SS.NAME).mode("overwrite").save(str(tmp_path / "o"))
