from collections import defaultdict

from headway.llm.decontaminate import find_leaks
from headway.llm.mixing import mix_sources


def test_mixing(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 4}" if i % 9 else None) for i in range(2000)] + [(None, "a b", "tiny"), (1, None, "s1"), (7, "", "s2"), (7, "", "s2")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    order = sorted(size, key=lambda s: (s is None, s or ""))
    level = {}
    for k, s in enumerate(order):
        assert target[s] <= 3 * size[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 50
        if target[s] < 3 * size[s] - 1e-9:
            level[s] = target[s] / (k % 3 + 1)
    assert max(level.values()) - min(level.values()) < 1e-6 * total
    assert target["tiny"] == 6 and taken["tiny"] == 6
    again = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string, size int")).count() == 0


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    noise = " ".join(f"n{i}" for i in range(3000))
    docs = [(1, f"{noise} {item.upper()}!! {noise}"), (2, noise), (3, item.replace("mu", "nu")), (4, "alpha beta gamma delta epsilon"), (5, None), (6, ""), (None, item), (1, "other"), (7, "tiny one"), (8, "a tiny one here")]
    items = [(10, item), (11, "tiny one"), (12, None), (13, ""), (None, item), (14, item)]
    docs = [(*d, 0) for d in docs]
    got = sorted(tuple(r) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 10, 8, 8, 1.0), (1, 14, 8, 8, 1.0), (3, 10, 8, 7, 0.875), (3, 14, 8, 7, 0.875), (7, 11, 1, 1, 1.0)]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), empty).count() == 0
