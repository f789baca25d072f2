import hashlib
import random
import re
import time
import zlib

from headway.llm.periodic_runs import collapse, op12_periodic_runs, periodic_runs, runs_of

SF = "/root/testdata/sf0.001"


def brute(x, least_length=6, least_exponent=4):
    """Every period, every maximal stretch of it, and no smaller period in that stretch."""
    found = set()
    for q in range(1, len(x) // least_exponent + 1):
        start = 0
        while start + q < len(x):
            end = start + q
            while end < len(x) and x[end] == x[end - q]:
                end += 1
            stretch = x[start:end]
            if len(stretch) >= max(least_length, least_exponent * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.add((start, len(stretch), q))
            start = max(start + 1, end - q + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    pick = random.Random(12)
    for _ in range(6000):
        x = [pick.randrange(pick.choice([1, 2, 2, 3, 5])) for _ in range(pick.randrange(70))]
        if len(x) > 10 and pick.random() < 0.7:
            a = pick.randrange(len(x))
            p = 1 + (len(x) - a) // pick.randint(3, 10)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(len(x))]
            if pick.random() < 0.4:
                x = x[: pick.randint(1, 9)] * pick.randint(1, 6) + x + x
        for length, exponent in ((6, 4), (2, 2), (5, 3)):
            assert runs_of(x, length, exponent) == brute(x, length, exponent), x


def test_time_is_linear():
    """Texts in which comparing letters from scratch takes quadratic time."""
    for x in ([1] * 400_000, [1, 2] * 200_000, ([1] * 1000 + [2]) * 400):
        began = time.time()
        assert (0, len(x)) in [r[:2] for r in runs_of(x)]
        assert time.time() - began < 20


def test_defined_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, "a a a a a", 7), (5, "x" + 7 * " a\u00a0b" + "\r\x0b y", 7), (6, "p q " * 20_000 + "é", 7), (None, "z z z z z z", 7), (4, "a a a a a", 7), (7, "a b a b a b a B", 7), (8, "a b c a b c a b c a b c q q q q q q", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {}
    for r in periodic_runs(docs, keep=("doc_id", "runs")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(5, [], "a a a a a")] * 2
    assert got[5] == [(9, [(1, 7, 1)], "x a\u00a0b y")]
    assert got[6] == [(40_001, [(0, 40_000, 2)], "p q é")]
    assert got[None] == [(6, [(0, 6, 1)], "z")]
    assert got[7] == [(8, [], "a b a b a b a B")]
    assert got[8] == [(18, [(0, 12, 3), (12, 6, 1)], "a b c q")]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 1500 else runs_of(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want[doc_id] = (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(collapse(w, runs)).encode()).hexdigest(),
        )
    out = op12_periodic_runs(spark, SF)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want and sum(v[0] for v in want.values()) > 10
    assert dict(out.dtypes) == {**{c: "bigint" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")}, "runs_sha256": "string", "collapsed_sha256": "string"}
