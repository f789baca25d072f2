"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import SHINGLE_WORDS, SIMILARITY, materialize


def _with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``w``: runs of letters and digits, lower-cased; null text has none."""
    return df.withColumn("w", F.expr(f"filter(split(lower(coalesce({text}, '')), r'[^\\p{{L}}\\p{{N}}]+'), x -> x <> '')"))


def _shingles(make: str) -> str:
    """An expression for each shingle of ``w``, or one for all of them if they are fewer than five. make: of a slice's parts."""
    k = SHINGLE_WORDS
    each = ", ".join("w[i]" if not j else f"w[i + {j}]" for j in range(k))
    return f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> {make.format(each)}) WHEN size(w) = 0 THEN array() ELSE array({make.format('array_join(w, chr(32))')}) END"


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment``: the items of which a document holds that share of shingles.

    Items are partitioned by size. MinHash orders shingles by a random hash, and an item's sketch is its bottom k
    values, with k one more than the shingles that it may lack at this threshold: so a document that contains the item
    holds at least one of them, whatever its own length. Each partition of sizes has a cut, the largest value in its
    sketches; shingles of documents above the largest cut are dropped before anything is exploded or joined. Candidates are
    verified with the shingles themselves, so the result is exact.

    Items under five words are out of reach inside longer documents: one is a single shingle of all its words, which only
    a document of exactly those words has.

    Rows with null or empty text on either side match nothing; rows that share a doc_id count as one document.
    """
    k = f"size(h) - cast(ceil({containment} * size(h)) as int) + 1"
    sketched = _with_words(items.select("item_id", "text").where("item_id is not null")).where("size(w) > 0").select("item_id", F.expr(f"array_sort(array_distinct({_shingles('xxhash64({})')}))").alias("h")).withColumn("band", F.expr("cast(floor(log2(size(h))) as int)"))
    sketch = materialize(sketched.select("item_id", "band", F.explode(F.expr(f"slice(h, 1, {k})")).alias("key")).distinct(), "sketches")
    cut = sketch.groupBy("band").agg(F.max("key").alias("cut")).agg(F.max("cut")).first()[0]
    cut = -(2**63) if cut is None else cut
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    probes = _with_words(texts).select("doc_id", F.explode(F.expr(f"filter({_shingles('xxhash64({})')}, x -> x <= {cut}L)" if cut > -(2**63) else "cast(array() as array<bigint>)")).alias("key"))
    found = materialize(probes.join(sketch.select("key", "item_id"), "key").select("doc_id", "item_id").distinct(), "leak-candidates")
    strings = f"array_distinct({_shingles("concat_ws(' ', {})")})"
    wanted = _with_words(items.select("item_id", "text")).select("item_id", F.expr(strings).alias("of_item"))
    pairs = _with_words(texts.join(found, "doc_id")).select("doc_id", "item_id", F.expr(strings).alias("of_doc")).join(wanted, "item_id")
    counted = pairs.select("doc_id", "item_id", F.size("of_item").cast("long").alias("n_shingles"), F.size(F.array_intersect("of_doc", "of_item")).cast("long").alias("n_found"))
    counted = counted.where(F.col("n_found") >= F.lit(containment) * F.col("n_shingles"))
    return counted.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found")).withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_leaks(read("documents"), read("benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k) WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k+4], ' ') ELSE array_to_string(w, ' ') END AS s FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, its.item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM ds JOIN its USING (s) JOIN n ON n.item_id = its.item_id GROUP BY doc_id, its.item_id, n_shingles HAVING count(*) >= 0.75 * n_shingles
"""
