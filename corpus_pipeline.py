"""The corpus pipeline: from ``documents`` to packed sequences.

Toxic documents go, then documents whose language cannot be told, then all
but one of each group of near-duplicates; the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.llm import language, near_dups, packing, toxicity
from matchops.llm.common import importable, table
from matchops.session import materialize

LEAST_SURE = 0.3  # of a language; four equally likely ones have 0.25 each


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    importable(spark)
    of = toxicity.scorer(spark, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(of(F.col("text")) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told better than by chance."""
    importable(spark)
    of = language.predictor(spark, language.fit(docs))
    found = docs.select("*", of("text").alias("_found"))
    return found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= LEAST_SURE)).drop("_found")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: that with the smallest id, of
    several such rows (or of rows that all have a null id) any one.

    Rows are told apart by a generated key that is written with them, so ids
    may be null or occur more than once."""
    importable(spark)
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = near_dups.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), words=5, threshold=0.8)
    rows = found.select(F.col("doc_id").alias("_row"), "component_id").join(keyed.select("_row", "doc_id"), "_row")
    rows = materialize(rows, "grouped")
    first = rows.groupBy("component_id").agg(
        F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(first, "component_id").where("_row <> first").select("_row")
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Two stages train a model and the last runs a tokenizer: not for SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each writes a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
