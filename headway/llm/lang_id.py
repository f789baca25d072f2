"""Language identification by multilingual mixture inference over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import _BYTES, mix64, text_chunks

#: Hashed n-gram features: byte 3-grams and 5-grams of the lower-cased text, other than letters as single spaces.
FEATURE_BITS = 15
GRAMS = (3, 5)
#: The classifier is fitted on about so many labelled documents of each language at most, chosen by hash.
SAMPLE_PER_LANGUAGE = 2000
EM_ROUNDS = 12
#: A further language must raise the log likelihood by this times log(n-grams); n-grams overlap, hence over one half.
PENALTY = 3.0
LEAST_SHARE = 0.03
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of each distinct n-gram of each row; and whether a row holds ASCII letters."""
    rows = len(offsets) - 1
    folded = _FOLD[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    letters = np.bincount(row[(folded >= 97) & (folded < 123)], minlength=rows) > 0
    first = np.empty(len(folded), bool)
    if len(folded):
        first[0] = True
        first[1:] = row[1:] != row[:-1]
    stays = folded != 32
    stays[1:] |= folded[:-1] != 32
    stays |= first
    folded, row = folded[stays], row[stays]
    keys = []
    for n in GRAMS:
        m = len(folded) - n + 1
        if m <= 0:
            continue
        x = np.full(m, np.uint64(n))
        for i in range(n):
            x = x * np.uint64(0x9E3779B97F4A7C15) + _BYTES[folded[i : i + m]]
        same = row[:m] == row[n - 1 :]
        keys.append((row[:m][same].astype(np.uint64) << np.uint64(FEATURE_BITS)) | (mix64(x[same]) >> np.uint64(64 - FEATURE_BITS)))
    if not keys:
        z = np.zeros(0, np.int64)
        return z, z, z, letters
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64), count, letters


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of each n-gram under each, from ``labelled(text, lang, key)``.

    Documents are chosen by the hash of ``key``, so many of each language as ``sample_per_language`` in expectation
    (all where there are fewer). Counts are summed within each Arrow batch, then by language and feature; only the
    table, as large as there are languages times features, reaches the driver: 131 kB a language once it is broadcast.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return [], np.zeros((1 << FEATURE_BITS, 0))
    languages = sorted(r["lang"] for r in sizes)
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_per_language / r["count"])) for r in sizes], "lang string, share double")
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    sample = labelled.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            names, code = np.unique(lang.astype(str), return_inverse=True)
            total = np.zeros((len(names), 1 << FEATURE_BITS), np.int64)
            for first, data, offsets in text_chunks(batch.column("text")):
                row, feature, n, _ = _grams(data, offsets)
                np.add.at(total, (code[first + row], feature), n)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[0]].tolist(), pa.string()), pa.array(at[1], pa.int32()), pa.array(total[at], pa.int64())], ["lang", "feature", "n"])

    counts = sample.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << FEATURE_BITS, len(languages)), 0.5)
    np.add.at(table, (counts["feature"].to_numpy(), np.searchsorted(languages, counts["lang"].to_numpy())), counts["n"].to_numpy())
    return languages, np.log(table / table.sum(axis=0))


def infer(log_p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Shares of all languages by expectation-maximisation, and the set of languages that penalised likelihood selects."""
    n, k = counts.sum(), log_p.shape[1]
    peak = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - peak)
    shares = np.full(k, 1 / k)
    for _ in range(EM_ROUNDS):
        mixed = p @ shares
        new = shares * (p.T @ (counts / mixed)) / n
        done = np.abs(new - shares).max() < 1e-3
        shares = new
        if done:
            break
    order = np.argsort(-shares, kind="stable")
    single = counts @ log_p
    chosen, best = [int(single.argmax())], float(single.max())
    for lang in order[: 1 + int((shares >= LEAST_SHARE).sum())]:
        if lang in chosen:
            continue
        tried = [*chosen, int(lang)]
        weight = np.maximum(shares[tried], 1e-9)
        weight = weight / weight.sum()
        for _ in range(4):
            mixed = p[:, tried] @ weight
            weight = weight * (p[:, tried].T @ (counts / mixed)) / n
        value = float(counts @ (np.log(p[:, tried] @ weight) + peak[:, 0]))
        if value - best > PENALTY * np.log(n + 1):
            chosen, best = tried, value
    return shares, chosen


def identify(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, langs``: the largest language, its share, and the set selected.

    Whole texts are scored. ``score`` is the share of the language by EM, drawn to an even split for very few n-grams.
    Null texts, texts without letters (of Unicode's category L; numerals such as ``½`` and ``Ⅷ`` are none), and all texts of a model without languages give ``und``, score 0 and no set.
    Texts with letters but too short for an n-gram give the first language of all. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "langs")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    table = table.astype(np.float32)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text = batch.column("text")
            pred, share, sets = [UNDETERMINED] * len(text), np.zeros(len(text)), [[] for _ in range(len(text))]
            for first, data, offsets in text_chunks(text) if languages else ():
                row, feature, n, letters = _grams(data, offsets)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    a, b = edges[r], edges[r + 1]
                    if not letters[r] and not any(map(str.isalpha, data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))):
                        continue
                    if a == b:
                        pred[first + r], share[first + r], sets[first + r] = languages[0], 1 / len(languages), [languages[0]]
                        continue
                    counts = n[a:b].astype(np.float64)
                    shares, chosen = infer(table[feature[a:b]].astype(np.float64), counts)
                    top = max(chosen, key=lambda i: shares[i])
                    total = counts.sum()
                    pred[first + r] = languages[top]
                    share[first + r] = min(1.0, (shares[top] * total + 1 / len(languages)) / (total + 1))
                    sets[first + r] = sorted(languages[i] for i in chosen)
            arrays = [batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(share), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "score", "langs"])

    return docs.select(*names).mapInArrow(score, f"{schema}, lang_pred string, score double, langs array<string>")


def is_held_out(doc_id: str = "doc_id"):
    """Held out of learning: crc32 of the doc_id as text, modulo 3, is 1. A null doc_id is not held out, and not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()).select("text", "lang", F.col("doc_id").alias("key")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_documents(docs)
    out = identify(docs.select("doc_id", "text"), *model)
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "langs")
