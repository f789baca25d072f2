import random

from headway.llm import jaccard_join
from headway.llm.jaccard_join import similar_documents


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set()
        sets[i] = s
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = [None, "", " \t\n", "one", "One  one", "a b c d", "A b\tc d", "a b c d e", "é É x y z"]
    passage = [word() for _ in range(40)]
    for n in (5, 6, 7, 8, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(n)]
            for _ in range(8):
                w = list(base)
                for _ in range(r.choice([0, 1, 1, 2, 3, max(1, n // 40)])):
                    k = r.randrange(len(w))
                    r.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k) if len(w) > 1 else None])()
                texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
            texts.append(" ".join(base + passage))
    return list(enumerate(texts + texts[30:36]))


def test_against_brute_force(spark):
    rows = corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < 0.75 * len(rows)


def test_defined_cases(spark):
    text = "the same five word shingles here"
    rows = [(None, text), (4, text), (4, text), (2, "the same five word shingles here"), (9, None)]
    got = sorted((tuple(r) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2), (9, 0, 9)], key=repr)
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string, n_shingles int")).count() == 0


def test_copies_just_below_the_threshold_are_not_paired(spark, monkeypatch):
    """Copies with two changed words link with their original, those with three don't, and each of a few has a copy of its own."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 241):
        w = list(base)
        for k in r.sample(range(10, 90, 6), 2 if i % 2 else 3):
            w[k] = word()
        rows.append((i, " ".join(w)))
        if i % 40 == 0:
            w[5] = word()
            rows.append((1000 + i, " ".join(w)))
    verified = []
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda pairs, texts, label: (verified.append(pairs.count()), linked(pairs, texts, label))[1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(verified) < 8 * len(rows), verified
