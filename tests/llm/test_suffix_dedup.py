import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from headway.llm import suffix_dedup
from headway.llm.common import materialize
from headway.llm.suffix_dedup import LENGTH, deep_shallow_order, remove_repeats


def brute(texts):
    rows = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + LENGTH] for b in rows for i in range(len(b) - LENGTH + 1))
    out = []
    for b in rows:
        cover = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                cover[i : i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i in range(len(b)) if cover[i] and (not i or not cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_order():
    r = random.Random(1)
    for n in (1, 2, 5, 40, 300):
        s = [bytes(r.choice(b"ab") for _ in range(r.randrange(200))) for _ in range(n)] + [b"a" * 150 + bytes([r.randrange(97, 100)]) * r.randrange(5) for _ in range(n)]
        assert [s[i] for i in deep_shallow_order(s)] == sorted(s)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefghij é\n") for _ in range(n))
    passages = [text(n) for n in (300, 390, 420, 600, 900, 1500)]
    out = [None, "", "short", "x" * 399, "y" * 400, "y" * 401, "z" * 3000, "ab" * 700, text(300) * 3]
    for _ in range(60):
        parts = [text(r.randrange(200))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 380))
            parts += [p[a : a + r.randrange(380, 1600)], text(r.randrange(60))]
        out.append("".join(parts))
    out += out[20:26] + [out[30]] * 5
    for t in out[40:50]:
        out.append(t[:50] + "#" + t[51:])
    return out


@pytest.mark.parametrize("group_rows", [1024, 3])
def test_against_brute_force(spark, group_rows):
    texts = corpus(5)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs, group_rows).collect()}
    want = {rows[i][0]: b for i, b in enumerate(brute(texts))}
    assert got == want


def test_empty_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, key int")).count() == 0
    docs = spark.createDataFrame([(1, "q" + "w" * 500), (1, "q" + "w" * 500)], "doc_id long, text string")
    assert {tuple(r)[1:4] for r in remove_repeats(docs).collect()} == {(501, 501, 1)}


def test_memory_of_anchors_and_size_of_batches(spark, monkeypatch):
    """A worker's arrays for anchors stay under 60 MB, and batches that bring it texts or contexts are small."""
    texts = pa.array(["".join(map(chr, r)) for r in np.random.default_rng(3).integers(97, 123, (1000, 2000))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), texts], ["doc_id", "key", "text"])
    list(suffix_dedup._anchor_rows([batch.slice(0, 10)]))
    tracemalloc.start()
    assert sum(b.num_rows for b in suffix_dedup._anchor_rows([batch])) > 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    before, rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), {}
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, label, n=None: rows.update({label: n}) or materialize(df, label, n))
    sized = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    assert max(r["n"] for r in materialize(spark.range(0, 9000, 1, 1).mapInArrow(sized, "n long"), "sizes", 2000).collect()) == 2000
    assert remove_repeats(spark.createDataFrame([(1, "q" * 500)], "doc_id long, text string")).count() == 1
    assert rows["anchors"] == rows["repeated-spans"] == 2000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
