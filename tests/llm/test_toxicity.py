import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from headway.llm.toxicity import FEATURES, SECOND_PERSON, Lexicon, _entry, _folded_words, fit_toxicity, is_held_out, op11_toxicity, score_toxicity, toxicity_features

SF = "/root/testdata/sf0.01"


def entries_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return _folded_words(data, np.array([0, len(data)]))


def test_folding():
    plain = _entry("idiot")
    for text in ("idiot", "Idiot,", "IDIOT!!", "1d10t", "i-d.iot", "idiiiot", "(idi0t)"):
        _, entries, mixed, stretched = entries_of(text)
        assert entries[0, 0] == plain, text
        assert (mixed[0], stretched[0]) == (text in ("1d10t", "i-d.iot", "(idi0t)"), text == "idiiiot"), text
    assert len(entries_of("12 100 -- !")[0]) == 0
    assert entries_of("idiotic")[1][0, 2] == plain, "a stem of five letters"
    row, *_ = _folded_words(np.frombuffer("abcd ef".encode(), np.uint8), np.array([0, 2, 2, 4, 7]))
    assert row.tolist() == [0, 2, 3]


def test_features_against_plain_python(spark):
    """Densities and proximity, word by word."""
    lexicon_words = {"idiot": 5.0, "scum": 3.0, "trash": 1.5}
    known = sorted((_entry(w), v) for w, v in lexicon_words.items())
    weights = np.array([v for _, v in known])
    lexicon = Lexicon(np.array([k for k, _ in known], np.uint64), weights, weights, weights)
    texts = ["You utter IDIOT and scum!", "the trash is out, you", "you a b c d e f scum", "you a b c d e scum", "", None, "Idiot " * 40_000, "nothing here"]
    got = [r["features"] for r in toxicity_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).orderBy("doc_id").collect()]
    for text, features in zip(texts, got, strict=True):
        f = dict(zip(FEATURES, features, strict=True))
        w = re.findall("[a-z]+", (text or "").lower())
        weight = [lexicon_words.get(x, 0) for x in w]
        told = [i for i, x in enumerate(w) if x in SECOND_PERSON]
        n = max(1, len(w))
        assert np.isclose(f["log_words"], np.log1p(len(w))) and f["best"] == max(weight, default=0)
        assert np.isclose(f["mild"], sum(x >= 1 for x in weight) / n) and np.isclose(f["clear"], sum(x >= 2 for x in weight) / n) and np.isclose(f["sure"], sum(x >= 4 for x in weight) / n)
        assert np.isclose(f["weight"], sum(weight) / n) and np.isclose(f["second"], sorted([0, 0, *weight])[-2])
        assert np.isclose(f["near_address"], sum(x >= 2 and any(abs(i - t) <= 6 for t in told) for i, x in enumerate(weight)) / n) and np.isclose(f["address"], len(told) / n)
        letters = re.findall("[A-Za-z]", text or "")
        assert np.isclose(f["capitals"], sum(c.isupper() for c in letters) / max(1, len(letters))) and np.isclose(f["exclaimed"], (text or "").count("!") / max(1, len(text or "")))


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op11_toxicity(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = out.toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    marked = got.merge(labels.toPandas(), on="doc_id")
    held = marked[marked["held_out"]]
    ranks = held["score"].rank()
    toxic, clean = held["toxic"] == 1, held["toxic"] == 0
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * clean.sum())
    assert area > 0.95 and (held["predicted"] == held["toxic"]).mean() > 0.93


def test_labels_of_held_out_rows_do_not_count(spark):
    """Turning every held-out label around changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (score_toxicity(docs.where("doc_id < 200"), fit_toxicity(docs, x.where(~is_held_out()))).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == other


def test_defined_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "you idiot", 9), (3, "you idiot", 9), (None, "calm words", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert {tuple(r) for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (None, 0.0, 0)}
    one = spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(docs, fit_toxicity(docs, one)).collect()} == {1}
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(real, spark.read.parquet(f"{SF}/labels.parquet"))
    got = score_toxicity(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and score_toxicity(docs.limit(0), model).count() == 0
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] < 0.5 and by_id[3] > by_id[None]
