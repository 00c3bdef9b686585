"""From raw documents to packed token sequences, in four stages.

Nulls: a null text counts as empty and fails the quality rules; a null language or source is a value of its own; rows with a null or repeated ``doc_id`` are judged,
kept and packed one by one.  Texts equal but for blanks leave one row, near copies one row; ties go to the smallest ``doc_id``.  Other columns, whatever their
names, stay until the last stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshobs.llm.best_fit_packing import best_fit_packing
from meshobs.llm.common import Scratch
from meshobs.llm.exact_dedup import survivors
from meshobs.llm.mcd_quality import accepted
from meshobs.llm.ngram_jaccard import representatives
from meshobs.llm.queries import JSON_VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return accepted(docs, docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return survivors(docs, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join, the one with the smallest id stays."""
    return representatives(docs, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token pieces in as few sequences as can be."""
    return best_fit_packing(docs, JSON_VOCABULARY)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("best-fit packing", packing)]

#: Robust estimates and bin packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read back for the next."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
