import json

from headway.operators import calibration as C
from headway.sources import reports as R


def write(folder, date, status="ok", cells=None, text=None):
    weekend = {"weekday": cells or {}, "weekend": {}}
    body = {"date": date, "status": status, "by_stops_ahead": cells or {}, "by_stops_ahead_weekend": weekend, "other": [1]}
    (folder / f"{date}.json").write_text(text if text is not None else json.dumps(body, indent=1))


def cell(n, mae, bias):
    return {"n": n, "mae_sec": mae, "bias_sec": bias}


def test_reports(spark, tmp_path):
    write(tmp_path, "2024-01-01", cells={"1": cell(900, 99, 99)})
    write(tmp_path, "2024-01-02", cells={"1": cell(300, 10, -4), "2": cell(300, 30, 6), "x": cell(300, 1, 1)})
    write(tmp_path, "2024-01-03", cells={"1": cell(100, 50, 12), "2": cell(100, 10, 2), "3": {"mae_sec": 1}})
    write(tmp_path, "2024-01-04", status="empty", cells={"1": cell(900, 99, 99)})
    write(tmp_path, "2024-01-05", text="{broken")
    write(tmp_path, "2024-01-06", text="")
    write(tmp_path, "latest", cells={"1": cell(900, 99, 99)})
    rows = R.quality_reports(spark, str(tmp_path), days=5)
    assert sorted((r["date"], r["stops_ahead"], r["n"]) for r in rows.collect()) == [("2024-01-02", 1, 300), ("2024-01-02", 2, 300), ("2024-01-03", 1, 100), ("2024-01-03", 2, 100)]
    # days are taken by name before their status is looked at: three of these four say nothing
    assert {r["date"] for r in R.quality_reports(spark, str(tmp_path), days=4).collect()} == {"2024-01-03"}
    assert R.quality_reports(spark, str(tmp_path), days=3).count() == 0
    assert {r["date"] for r in R.quality_reports(spark, str(tmp_path), days=9, since="2024-01-03").collect()} == {"2024-01-03"}
    assert R.quality_reports(spark, str(tmp_path), days=9, since="2025-01-01").count() == 0
    assert {r["stops_ahead"]: r["mae_sec"] for r in C.pooled_mae(rows).collect()} == {1: 20, 2: 25}
    assert {r["stops_ahead"]: r["bias_sec"] for r in C.pooled_bias(rows).collect()} == {1: 0, 2: 5}
    of_days = R.quality_reports(spark, str(tmp_path), days=5, by_day=True)
    assert {(r["day"], r["stops_ahead"]): r["bias_sec"] for r in C.pooled_bias(of_days, ("day",)).collect()} == {("weekday", 1): 0, ("weekday", 2): 5}
