"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but
the last return the columns of ``documents``. Every stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import materialize
from headway.llm.decontaminate import find_leaks
from headway.llm.jaccard_join import BROADCAST_IDS, similar_documents
from headway.llm.lang_id import UNDETERMINED, fit_documents, identify
from headway.llm.line_dedup import dedup_lines
from headway.llm.mixing import mix_sources

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of three languages or more stays if one of them has this share.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in ``ids``: by broadcast up to BROADCAST_IDS, else by a shuffle."""
    ids = materialize(ids.distinct(), "dropped-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, no letters) and jumbles of languages; fills in ``lang`` where it is null."""
    found = identify(docs.select(*COLUMNS), *fit_documents(docs))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & ((F.size("langs") < 3) | (F.col("score") >= LEAST_SHARE)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat earlier ones; texts that have no other lines go."""
    rest = dedup_lines(docs.select(*COLUMNS))
    return rest.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least doc_id."""
    return _without(docs, similar_documents(docs).where("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (``taken / size``)."""
    return mix_sources(docs, keep=("text", "lang", "n_chars")).where("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("mix", mix)]

#: SQL can't express the first two stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
