"""From raw documents to packed training sequences.

Five stages, each over all that the one before it kept: documents without a recognisable
language go, lines that many documents share go, one document of each group of near duplicates
stays, documents with a benchmark passage go, and the rest is packed. All stages but the last
return the columns of ``documents``.

Documents with null texts or null ids, repeated rows and empty tables pass through as the
operators define it; a null text has no language and goes in the first stage, null ids belong
to no group of near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from meterfold.llm.common import stored, table

#: Below it no language stands out: with four languages, an even guess scores 0.25.
MIN_LANGUAGE_SCORE = 0.35


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with some certainty; the classifier learns from their labels."""
    found = language_id.predict(docs, language_id.fit(docs), keep=True)
    keep = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(keep).select("given.*")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    kept = jaccard_join.classes(docs).filter("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", recognised),
    ("lines", without_shared_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmarks", decontaminated),
    ("packing", packed),
]

# Language identification, fingerprints and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
