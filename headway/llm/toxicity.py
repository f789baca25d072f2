"""Toxicity: gradient-boosted trees over dense features of lexicon, address and spelling, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import _BYTES, _powers, discard, materialize, mix64, text_chunks

#: About so many labelled documents of each class are learnt from at most, chosen by hash and weighted by how many they stand for.
SAMPLE_TOXIC, SAMPLE_CLEAN = 8000, 16_000
#: Entries of the learnt lexicon at most, those that tell most; letters (bytes) of the stems that are tried beside whole words.
LEXICON, STEMS = 4096, (4, 5, 6)
#: A word counts as near an address within so many words.
REACH = 6
#: Lower bounds of an entry's log odds from which a word counts as mildly, clearly and surely of the lexicon.
LEVELS = (1.0, 2.0, 4.0)
ROUNDS, DEPTH, STEP = 30, 3, 0.2
#: Share of the trees' own probability in the score, so that ties of the calibration keep their order.
TIE_SHARE = 0.01

# Second-person words and common insults of English, German, French and Spanish; digits and signs that stand for letters.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "deiner", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
SEEDS = ("idiot", "idiots", "moron", "stupid", "dumb", "fool", "jerk", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "dumm", "dummkopf", "trottel", "abschaum", "ekelhaft", "wertlos", "imbécile", "crétin", "débile", "ordure", "dégoûtant", "connard", "salaud", "idiota", "estúpido", "imbécil", "basura", "asqueroso", "patético", "tonto", "inútil")
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("log_words", "best", "second", "mild", "clear", "sure", "n_clear", "weight", "near_address", "address", "seeds", "capitals", "shouted", "exclaimed", "punctuation", "mixed", "stretched")

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-case letters with stand-ins as letters; white space as 32; everything else as 0, to be left out.
_FOLD = np.zeros(256, np.uint8)
_FOLD[_LETTER] = np.flatnonzero(_LETTER)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32
for _sign, _letter in STAND_INS.items():
    _FOLD[ord(_sign)] = ord(_letter)


def _folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, entries (the word and its stems; 0 for none), and whether stand-ins or signs, or letters three times over, were folded.

    Words are cut at white space; signs within them are left out and equal letters in a row count once, so that
    ``st00pid``, ``stu-pid`` and ``stuuupid`` are all one entry. Words without a letter of their own are left out.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    word = np.cumsum(begins) - 1
    n = int(begins.sum())
    inside = ~space
    own = np.bincount(word[inside], _LETTER[data[inside]], n)
    same = np.zeros(len(data), bool)
    folded = _FOLD[data]
    same[1:] = (folded[1:] == folded[:-1]) & ~first[1:] & inside[1:] & (data[1:] < 128)
    thrice = np.zeros(len(data), bool)
    thrice[2:] = same[2:] & same[1:-1]
    odd_sign = inside & (folded != 0) & ~_LETTER[data]
    dropped = inside & (folded == 0)
    amid = np.zeros(len(data), bool)  # a dropped sign between letters
    if len(data) > 2:
        amid[1:-1] = dropped[1:-1] & _LETTER[data[:-2]] & _LETTER[data[2:]] & ~first[1:-1] & ~first[2:]
    mixed = np.bincount(word[inside], odd_sign[inside] | amid[inside], n) > 0
    stretched = np.bincount(word[inside], thrice[inside] & _LETTER[data[inside]], n) > 0
    keep = inside & (folded != 0) & ~same
    text, of = folded[keep], word[keep]
    size = np.bincount(of, minlength=n)
    stop = np.cumsum(size)
    start = stop - size
    up, down = _powers(max(1, len(text)))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * up[: len(text)], out=sums[1:])
    entries = np.zeros((n, 1 + len(STEMS)), np.uint64)
    for k, most in enumerate((1 << 62, *STEMS)):
        to = np.minimum(stop, start + most)
        some = (size > most) if k else (size > 0)
        entries[some, k] = mix64((sums[to[some]] - sums[start[some]]) * down[start[some]] + size[some].clip(max=most).astype(np.uint64))
    real = own > 0
    return row[begins][real], entries[real], mixed[real] & (own[real] > 1), stretched[real]


def _entry(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_folded_words(data, np.array([0, len(data)]))[1][0, 0])


@dataclass
class Lexicon:
    """Sorted entries; the weight of each, and its weight if one toxic, or one clean, document more were not known of."""

    entries: np.ndarray
    weight: np.ndarray
    without_toxic: np.ndarray
    without_clean: np.ndarray


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of an entry in toxic documents less 1.5 standard errors, or 0."""
    toxic, clean = np.maximum(toxic, 0) + 0.5, np.maximum(clean, 0) + 0.5
    odds = np.log(toxic / (n_toxic + 1)) - np.log(clean / (n_clean + 1)) - 1.5 * np.sqrt(1 / toxic + 1 / clean)
    return np.maximum(odds, 0)


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Words and stems that tell toxic documents, from ``sample(text, toxic)``; at most LEXICON reach the driver."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            label = np.array(batch.column("toxic").to_pylist(), np.int64)
            for first, data, offsets in text_chunks(batch.column("text")):
                row, entries, _, _ = _folded_words(data, offsets)
                pairs = np.unique(np.stack([np.repeat(row.astype(np.uint64), entries.shape[1]), entries.ravel()], 1), axis=0)
                pairs = pairs[pairs[:, 1] > 0]
                found, at = np.unique(pairs[:, 1], return_inverse=True)
                toxic = np.bincount(at, label[first + pairs[:, 0].astype(np.int64)], len(found)).astype(np.int64)
                both = np.bincount(at, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["entry", "toxic", "clean"])

    counts = sample.select("text", "toxic").mapInArrow(count, "entry long, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1)) - 1.5 * F.sqrt(1 / t + 1 / c)
    top = counts.withColumn("odds", odds).where(F.col("odds") >= LEVELS[0]).orderBy(F.desc("odds"), "entry").limit(LEXICON).toPandas()
    top = top.assign(entry=top["entry"].to_numpy(np.int64).view(np.uint64)).sort_values("entry")
    toxic, clean = top["toxic"].to_numpy(np.float64), top["clean"].to_numpy(np.float64)
    return Lexicon(top["entry"].to_numpy(np.uint64), _weights(toxic, clean, n_toxic, n_clean), _weights(toxic - 1, clean, n_toxic - 1, n_clean), _weights(toxic, clean - 1, n_toxic, n_clean - 1))


def _features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, table: np.ndarray, likely: np.ndarray, address: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; ``table`` has the weight of each entry of the lexicon."""
    n = len(offsets) - 1
    row, entries, mixed, stretched = _folded_words(data, offsets)
    words = np.bincount(row, minlength=n)
    flat = entries.ravel()
    at = np.flatnonzero(likely[(flat >> np.uint64(48)).astype(np.int64)])
    place = np.searchsorted(lexicon.entries, flat[at]).clip(max=max(0, len(lexicon.entries) - 1))
    hit = lexicon.entries[place] == flat[at] if len(lexicon.entries) else np.zeros(len(at), bool)
    at, place = at[hit], place[hit]
    weight = np.zeros(len(row))
    np.maximum.at(weight, at // entries.shape[1], table[place])
    share = lambda x, of=words: np.bincount(row, x, n) / np.maximum(of, 1)
    best, second = np.zeros(n), np.zeros(n)
    np.maximum.at(best, row, weight)
    top = np.flatnonzero(weight >= LEVELS[0])
    order = top[np.lexsort((-weight[top], row[top]))]
    next_of = order[1:][(row[order[1:]] == row[order[:-1]])]
    np.maximum.at(second, row[next_of], weight[next_of])
    told = np.flatnonzero(np.isin(entries[:, 0], address))
    marked = np.flatnonzero(weight >= LEVELS[1])
    close = np.zeros(len(row))
    if len(told) and len(marked):
        k = np.searchsorted(told, marked)
        for side in (np.minimum(k, len(told) - 1), np.maximum(k - 1, 0)):
            close[marked] = np.maximum(close[marked], (np.abs(told[side] - marked) <= REACH) & (row[told[side]] == row[marked]))
    is_told = np.zeros(len(row))
    is_told[told] = 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    size = np.maximum(np.diff(offsets), 1)
    letters = np.bincount(of, upper | lower, n)
    capital = np.bincount(of, upper, n)
    pair = np.zeros(len(data), bool)  # capitals next to each other
    if len(data):
        pair[1:] = upper[1:] & upper[:-1] & (of[1:] == of[:-1])
    signs = (data > 32) & (data < 127) & ~upper & ~lower & ~((data >= 48) & (data <= 57))
    return np.stack(
        [
            np.log1p(words), best, second, *(share(weight >= level) for level in LEVELS), np.log1p(np.bincount(row, weight >= LEVELS[1], n)), share(weight), share(close), share(is_told), share(np.isin(entries[:, 0], seeds)),
            capital / np.maximum(letters, 1), np.bincount(of, pair, n) / np.maximum(letters, 1), np.bincount(of, data == 33, n) / size, np.bincount(of, signs, n) / size, share(mixed), share(stretched),
        ],
        axis=1,
    )


def toxicity_features(docs: DataFrame, lexicon: Lexicon, label: str | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``features`` (FEATURES) of the whole text; of null and empty texts all 0.

    With ``label``, the column of what is known of each row, an entry counts as if that row had not been learnt from.
    A column ``features`` is replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "features")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    likely = np.zeros(1 << 16, bool)
    likely[(lexicon.entries >> np.uint64(48)).astype(np.int64)] = True
    address, seeds = (np.array([_entry(w) for w in listed], np.uint64) for listed in (SECOND_PERSON, SEEDS))

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            known = np.array(batch.column(label).to_pylist(), np.int64) if label else None
            parts = []
            for first, data, offsets in text_chunks(batch.column("text")):
                rows = len(offsets) - 1
                if known is None:
                    parts.append(_features(data, offsets, lexicon, lexicon.weight, likely, address, seeds))
                    continue
                both = [_features(data, offsets, lexicon, table, likely, address, seeds) for table in (lexicon.without_clean, lexicon.without_toxic)]
                parts.append(np.where((known[first : first + rows] == 1)[:, None], both[1], both[0]))
            flat = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            features = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), features], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(compute, f"{schema}{', ' * bool(keep)}features array<double>")


@dataclass
class ToxicityModel:
    """``trees`` is None where one of the classes was not seen; every score is ``prior`` then."""

    lexicon: Lexicon
    prior: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def _chance(key: str, salt: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> ToxicityModel:
    """Learns from the rows of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks.

    Rows of null ids and marks are left out; of several marks of a document the highest counts. Two thirds of the
    sample, by hash, grow the trees and the rest calibrates them; the lexicon is learnt from all of it, and each
    document's own share in it is taken back for its features. Where no document of a class is marked, the model gives
    the share of toxic ones (0 if nothing is marked).
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = np.zeros(0)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    none = ToxicityModel(Lexicon(empty.astype(np.uint64), empty, empty, empty), prior)
    if not sizes.get(1) or not sizes.get(0):
        return none
    share = {1: min(1.0, sample_toxic / sizes[1]), 0: min(1.0, sample_clean / sizes[0])}
    of = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    chosen = marks.where(_chance("doc_id", "toxic:") < of).withColumn("weight", 1 / of)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not seen.get(1) or not seen.get(0):
        discard(sample)
        return none
    lexicon = learn_lexicon(sample, seen[1], seen[0])
    vectors = toxicity_features(sample, lexicon, "toxic").select("doc_id", F.col("toxic").cast("double").alias("label"), "weight", array_to_vector("features").alias("features"))
    vectors = materialize(vectors.coalesce(4), "toxicity-features")
    part = _chance("doc_id", "calibrate:")
    growing, rest = vectors.where(part >= 1 / 3), vectors.where(part < 1 / 3)
    if growing.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        growing = rest = vectors
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, weightCol="weight", seed=11).fit(growing)
    raw = trees.transform(rest).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(raw)
    discard(sample, vectors)
    return ToxicityModel(lexicon, prior, trees, calibration)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on).

    Every whole text is scored, null and empty ones as texts without words. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    if model.trees is None:
        scored = docs.select(*names, F.lit(model.prior).alias("score"))
    else:
        vectors = toxicity_features(docs.select(F.struct(*names).alias("row"), "text"), model.lexicon).withColumn("features", array_to_vector("features"))
        raw = model.trees.transform(vectors).select("row", vector_to_array("probability")[1].alias("raw"))
        value = (1 - TIE_SHARE) * F.col("calibrated") + TIE_SHARE * F.col("raw")
        scored = model.calibration.transform(raw).select("row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def is_held_out(doc_id: str = "doc_id"):
    """Held out of learning: 5 divides the crc32 of the doc_id as text. A null doc_id is not held out, and not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~is_held_out())
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
