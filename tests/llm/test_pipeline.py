from collections import defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from headway.llm.lang_id import fit_documents, identify
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def shingle_set(t):
    w = [x for x in __import__("regex").split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
    return set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set()


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for _, stage in P.STAGES:
        inputs.append(P.materialize(stage(spark, inputs[-1], SF), "test"))
    assert all(tuple(d.columns) == P.COLUMNS for d in inputs[:-1])
    of = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in inputs]
    judged = identify(docs, *fit_documents(docs)).where("lang_pred <> 'und'").where((F.size("langs") < 3) | (F.col("score") >= 0.5))
    assert set(of[1]) == {r["doc_id"] for r in judged.collect()} and len(of[1]) >= 0.98 * len(of[0])
    want = {i: t for i, t in lines(spark, sorted(of[1].items())) if t == of[1][i] or t.strip(" ")}
    assert of[2] == want
    assert set(of[3]) == {i for i, (_, c) in groups(sorted(of[2].items())).items() if c == i}
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingle_set(r["text"]))]
    assert set(of[4]) == {i for i, t in of[3].items() if not any(len(s & shingle_set(t)) >= 0.75 * len(s) for s in items)}
    taken = defaultdict(int)
    for r in inputs[-1].collect():
        assert r["taken"] > 0 and r["text"] == of[4][r["doc_id"]]
        taken[r["source"], r["target"]] += r["taken"]
    longest = max(len(t.split()) for t in of[4].values())
    assert taken and all(abs(n - target) <= longest for (_, target), n in taken.items())


def test_run(spark):
    assert P.run(spark, SF).count() > 0
