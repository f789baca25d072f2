import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from headway.llm import line_dedup
from headway.llm.line_dedup import LEAST_WORDS, MOST_BITS, SIMILARITY, _lines, dedup_lines, group_lines, sim_hash


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(spark, rows):
    """All pairs of lines, with the SimHash values of the operator."""
    places = [(i, p, x.strip(" \t\r").lower()) for i, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    places = sorted((x for x in places if x[2]), key=lambda x: x[:2])
    lines = sorted({x[2] for x in places})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    sim = {lines[r["id"]]: r["simhash"] & (2**64 - 1) for r in sim_hash(df).collect()}
    group = {x: x for x in lines}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if a in sim and b in sim and min(len(a), len(b)) >= 2 * LEAST_WORDS - 1 and bin(sim[a] ^ sim[b]).count("1") <= MOST_BITS and 1 - edit(a, b) / max(len(a), len(b)) >= SIMILARITY - 1e-9:
                group[find(a)] = find(b)
    kept, goes = {}, set()
    for i, p, x in places:
        if kept.setdefault(find(x), (i, p)) != (i, p):
            goes.add((i, p))
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in goes)) for i, t in rows]


def test_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (1, 3, 5, 8, 20, 40, 60, 80)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, base[0]), (4, base[0].upper() + " \n" + base[0])]
    for i in range(5, 60):
        text = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(base).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            text.append(" ".join(w).capitalize() + r.choice(["", ".", "!", "\t", "\r"]))
        rows.append((i, "\n".join(text)))
    docs = spark.createDataFrame([(*x, "src") for x in rows], "doc_id long, text string, n_lines string")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted((x["doc_id"], x["text"]) for x in out.collect() if x["doc_id"])
    want = sorted(x for x in brute(spark, rows) if x[0])
    assert got == want
    assert sum(len(t or "") for _, t in got) < 0.9 * sum(len(t or "") for _, t in rows)


def test_votes_are_majorities(spark):
    df = spark.createDataFrame([(1, "one two three four five"), (2, "one two"), (3, " ".join(["same"] * 70_000))], "id long, norm string")
    words = {r["w"]: r["h"] & (2**64 - 1) for r in spark.sql("SELECT w, xxhash64(w) AS h FROM VALUES ('one'), ('two'), ('three'), ('four'), ('five'), ('same') AS t(w)").collect()}
    got = {r["id"]: r["simhash"] & (2**64 - 1) for r in sim_hash(df).collect()}
    five = [words[w] for w in "one two three four five".split()]
    assert got == {1: sum(1 << b for b in range(64) if sum(h >> b & 1 for h in five) >= 3), 3: words["same"]}


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(empty).count() == 0
    rows = [(None, "a line of its own"), (5, "a line of its own\nanother"), (5, "a line of its own\nanother"), (6, "Another ")]
    got = sorted((tuple(r) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, "a line of its own", 1, 0), (5, "another", 2, 1), (5, "another", 2, 1), (6, "", 1, 1)], key=repr)


def recall(spark, folder, longest):
    """Of all pairs of different lines with edit similarity 0.8, found without SimHash, the share that one group holds."""
    import duckdb

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    lines = _lines(docs).where(F.length("norm") <= longest)
    _, keeps = group_lines(docs)
    group = lines.join(keeps, ["k1", "k2"], "left").select("norm", F.struct("keep_doc", "keep_pos").alias("keep")).distinct()
    kept = {r["norm"]: tuple(r["keep"]) if r["keep"]["keep_doc"] is not None else None for r in group.collect()}
    known = sorted(kept)
    letters = sorted({c for x in known for c in x})
    counts = np.zeros((len(known), len(letters)), np.int32)
    for i, x in enumerate(known):
        for c in x:
            counts[i, letters.index(c)] += 1
    size = counts.sum(1)
    a, b = [], []
    for i in range(len(known)):
        over = counts[i + 1 :] - counts[i]
        least = np.maximum(np.maximum(over, 0).sum(1), np.maximum(-over, 0).sum(1))
        for j in i + 1 + np.flatnonzero(least <= 0.2 * np.maximum(size[i], size[i + 1 :]) + 1e-9):
            a.append(known[i])
            b.append(known[j])
    candidates = pd.DataFrame({"a": a, "b": b})  # noqa: F841
    pairs = duckdb.sql("SELECT a, b FROM candidates WHERE levenshtein(a, b) <= floor(0.2 * greatest(length(a), length(b)) + 1e-9)").fetchall()
    found = sum(kept[x] is not None and kept[x] == kept[y] for x, y in pairs)
    return found, len(pairs)


def test_recall_against_all_pairs(spark):
    found, pairs = recall(spark, "/root/testdata/sf0.001", 400)
    assert pairs >= 25 and found >= 0.9 * pairs, (found, pairs)


def test_hashes_are_those_of_spark(spark):
    r = random.Random(4)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in (*range(1, 70), 95, 96, 97, 300)]
    ends = np.cumsum([len(w) for w in words])
    got = line_dedup._xxhash64(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "id int, w binary").select("id", F.xxhash64("w").alias("h"))
    assert [x & (1 << 64) - 1 for _, x in sorted(map(tuple, df.collect()))] == got.tolist()


def test_similar_is_the_edit_similarity():
    r = random.Random(6)
    for _ in range(1500):
        a = "".join(r.choice("abc \u00e9") for _ in range(r.randrange(40)))
        b = list(a)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.choice("abc \u00e9")] * r.randrange(2)
        b = "".join(b)
        assert line_dedup.similar(a, b) == (edit(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)), (a, b)


def test_blocks_vote_by_part(spark):
    """Against votes counted one by one, with parts of more than 255 words."""
    lines = [" ".join(f"w{i}" for i in range(n)) for n in (4, 5, 40, 3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, norm string")
    hashes = {r["id"]: r["h"] for r in df.select("id", F.expr("transform(split(norm, ' '), w -> xxhash64(w))").alias("h")).collect()}
    for r in line_dedup._add_blocks(df).collect():
        if r["id"] == 0:
            assert tuple(r)[1:] == (None,) * 4
            continue
        parts = [[h for h in hashes[r["id"]] if (h + 2**63) * line_dedup.PARTS >> 64 == p] for p in range(line_dedup.PARTS)]
        bits = [sum(1 << b for b in (s + 8 * lane for s in range(3) for lane in range(8)) if 2 * sum(h >> b & 1 for h in p) > len(p)) for p in parts]
        assert tuple(r)[1:4] == tuple(bits[i] | bits[i + 1] << 3 for i in (0, 2, 4)) and r["n_words"] == len(hashes[r["id"]])


def test_lines_of_any_length_are_compared(spark):
    """Over 32,767 different words in a part."""
    words = [f"w{i}" for i in range(200_000)]
    edited = " ".join([*words[:9], "other", *words[10:]])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short\n" + edited), (3, "a line of its own")], "doc_id long, text string")
    assert line_dedup._add_blocks(_lines(docs).where("doc_id < 3 AND pos = doc_id - 1")).where("f0 IS NULL OR f1 IS NULL OR f2 IS NULL").count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}
