"""The training-data pipeline over documents: each stage works on all that its predecessor kept.

quality -> exact dedup -> near duplicates -> personal data -> packing. All stages but the last return the columns of
documents; run() applies them to the documents table, writing each stage's result to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import stage_exact_dedup
from tessera.llm.jaccard_join import stage_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.pii import stage_pii
from tessera.llm.quality import stage_quality
from tessera.llm.tables import table
from tessera.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return stage_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return stage_exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one document stays."""
    return stage_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind's name in all texts."""
    return stage_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, placed in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: SQL can't express the learnt stages; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: a row per piece of a document, with its ids and its place in a sequence."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
