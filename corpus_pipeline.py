"""A training-data pipeline over ``documents``: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage gets all rows its predecessor kept.  The first three drop rows, the fourth rewrites texts, the last
turns what is left into packed token sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from medallion.llm import decontaminate, near_dup, packing, pii, quality
from medallion.llm.common import Scratch, table
from medallion.session import materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_work: ContextVar[Scratch | None] = ContextVar("pipeline_work", default=None)


def _stage(fn: Stage) -> Stage:
    """Every stage's result is written before the next one begins, so the work tables before it can go.

    Those of a thread only: pipelines may run side by side.
    """
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _work.get() is None:
            _work.set(Scratch())
        work = _work.get()
        work.drop(spark)
        with work:
            return fn(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.deduplicate(docs)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "documents")


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return pii.redact(docs, length="n_chars")


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, tokenizers and learned patterns have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
