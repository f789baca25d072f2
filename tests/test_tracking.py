import datetime as dt
import math
import random

from headway.operators import matching as M

FIXES = "vehicle_id string, day date, seq long, t double, route_id string, x double, y double"
CANDIDATES = "vehicle_id string, day date, seq long, trip_id string, score double, off_m double, bearing_diff double, trusted boolean"
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def plainly(fixes, candidates):
    """One vehicle's day after another, a fix at a time."""
    out = {}
    state: dict = {}
    for vehicle, day, seq, _, route, x, y in sorted(fixes, key=lambda f: (f[0], f[1], f[3], f[2])):
        s = state.setdefault((vehicle, day), {"trip": None, "off": False, "n": 0, "d": []})
        if not route or x is None or y is None:
            out[vehicle, seq] = (None, None, None, False, False)
            continue
        cs = sorted(((c[5] / 100 if c[7] else c[4]), c[3], c[5], c[6], bool(c[7])) for c in candidates if c[:3] == (vehicle, day, seq))
        sure = [c for c in cs if c[4]]
        best = sure[0] if sure else next((c for c in cs if c[0] < math.inf), None)
        if not sure:
            before = next((c for c in cs if c[1] == s["trip"]), None)
            if before and before[2] <= 150 and before[2] <= (best[2] if best else math.inf):
                best = before
        d = sure[0][2] if sure else min((c[2] for c in cs), default=math.inf)
        s["d"].append(d)
        away = len(s["d"]) >= 3 and s["d"][-1] > s["d"][-2] > s["d"][-3] and d > 100
        wrong = best is not None and best[3] is not None and best[3] > 90 and d > 50
        signal = d <= 100 if s["off"] else d > 150 or wrong or away
        s["n"] = s["n"] + 1 if signal else 0
        if s["n"] >= 3:
            s["off"], s["n"] = not s["off"], 0
        s["trip"] = None if s["off"] or best is None else best[1]
        score = best[0] if best and best[0] < math.inf else None
        out[vehicle, seq] = (s["trip"], score, best and best[2], bool(best and best[2] < 50 and not s["off"]), s["off"])
    return out


def tracked(spark, fixes, candidates):
    rows = M.tracked_trips(spark.createDataFrame(fixes, FIXES), spark.createDataFrame(candidates, CANDIDATES)).collect()
    assert len(rows) == len(fixes)
    return {(r["vehicle_id"], r["seq"]): (r["trip_id"], r["score"], r["off_m"], r["high_confidence"], r["off_route"]) for r in rows}


def test_equals_the_plain_walk(spark):
    pick = random.Random(11)
    fixes, candidates = [], []
    for v in range(6):
        off = pick.uniform(0, 200)
        for i in range(140):
            day, seq = (D1 if i < 90 else D2), v * 1000 + i
            fixes.append((f"v{v}", day, seq, float(i // 2), pick.choice(["r", "r", "r", "r", "", None]) if v % 2 else "r", None if pick.random() < 0.05 else 1.0, 1.0))
            off = min(260.0, max(0.0, off + pick.uniform(-60, 60)))
            for k in range(pick.choice([0, 1, 3, 3, 3])):
                at = round(max(0.0, off + pick.choice([0, 0, 10, 40])), 1)
                score = math.inf if at > 100 else round(at / 250 + pick.choice([0.1, 0.1, 0.3]), 3)
                candidates.append((f"v{v}", day, seq, f"t{k}", score, at, pick.choice([None, 10.0, 120.0]), at < 50 and k == 1 and pick.random() < 0.3))
    got, want = tracked(spark, fixes, candidates), plainly(fixes, candidates)
    assert got == want
    kinds = {(bool(r[0]), r[4]) for r in want.values()}
    assert kinds == {(True, False), (False, False), (False, True)} and any(r[0] and r[1] is None for r in want.values())


def test_cases(spark):
    fix = lambda i, route="r", x=1.0, day=D1: ("v", day, i, float(i), route, x, 1.0)
    one = lambda i, trip, score, off, sure=False, day=D1, diff=None: ("v", day, i, trip, score, off, diff, sure)
    fixes = [fix(1), fix(2), fix(3, None), fix(4), fix(5, day=D2), fix(6), fix(7), fix(8), fix(9, x=None)]
    candidates = [one(1, "a", 0.1, 10.0), one(1, "b", 0.1, 10.0), one(2, "a", 0.4, 20.0), one(2, "b", 0.2, 20.0), one(4, "a", 0.4, 30.0), one(4, "b", 0.2, 20.0), one(5, "a", 0.4, 20.0, day=D2), one(5, "b", 0.2, 20.0, day=D2)]
    got = tracked(spark, fixes, candidates)
    assert got["v", 1][0] == "a"  # of equals the first
    assert got["v", 2][:2] == ("a", 0.4)  # as near as the better one: it stays
    assert got["v", 3] == (None, None, None, False, False)  # passed through, and the trip is still remembered
    assert got["v", 4][0] == "b"  # farther off than the better one: it goes
    assert got["v", 5][0] == "b"  # another day remembers nothing
    assert [got["v", i][4] for i in (6, 7, 8)] == [False, False, True]  # three fixes without a candidate
    assert got["v", 9] == (None, None, None, False, False)
    sure = tracked(spark, [fix(1), fix(2)], [one(1, "a", 0.2, 10.0), one(2, "a", 0.3, 30.0), one(2, "z", 0.9, 40.0, True)])
    assert sure["v", 2] == ("z", 0.4, 40.0, True, False)  # believed without asking the one before


def test_empty(spark):
    assert tracked(spark, [], []) == {}
    assert tracked(spark, [("v", D1, 1, 0.0, "r", 1.0, 1.0)], []) == {("v", 1): (None, None, None, False, False)}
