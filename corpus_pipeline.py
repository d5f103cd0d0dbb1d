"""A training-data pipeline over ``documents``: every stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import decontam, exact, quality, simhash
from verdictlake.llm.common import crc_mod, stage, table
from verdictlake.llm.queries import bpe_digests


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels, doesn't reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    return quality.keep_good(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact.dedup_exact(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near-duplicates: texts whose sets of five-word shingles are alike to 0.8 or more."""
    return simhash.dedup_near(docs, width=5, similar=True)


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as counts and digests of ids and decoded text."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("simhash near-dedup", keep_unlike),
    ("benchmark decontamination", keep_untested),
    ("bpe encoding", to_tokens),
]

#: SQL doesn't express the classifier; tests/llm/test_pipeline.py has the stages in plain Python and compares the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
