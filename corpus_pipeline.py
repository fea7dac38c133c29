"""Corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on everything
its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import classifier, near_copies, packing, secrets, substring_dedup
from webloom.llm.common import discard, saved, table
from webloom.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (Jaccard 0.8 or more over five words): that of the smallest doc_id."""
    return near_copies.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a smaller doc_id has are cut from the text; every document stays."""
    return _counted(substring_dedup.deduplicated(docs), docs)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is masked in the text; every document stays."""
    return _counted(secrets.redacted(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"))


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("secret_scans", credentials),
    ("best_fit_packing", packed),
]

#: Nearest neighbours, components and packing have no SQL form; tests hold run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        discard(before)  # what the stages before left is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
