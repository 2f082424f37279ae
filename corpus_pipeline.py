"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages read the columns doc_id, text and source (and n_chars where it is one)
and hand on all others as they are, whatever their names. What a stage does with
nulls, empty texts, ties and repeated rows stands with the function it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules
from braidwork.llm.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: ``quality_rules.without_rejected``."""
    return quality_rules.without_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, alike, in the corpus: ``line_dedup.without_repeats``."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: ``ngram_join.without_copies``."""
    return ngram_join.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: ``decontaminate.without_leaks``."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt by source to target weights, once for each pass that takes them: ``mixing.mixed``."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Banding and hashed permutations have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents`` in ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name=name)
    return STAGES[-1][1](spark, docs, sf_dir)
