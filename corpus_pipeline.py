"""The corpus pipeline: language, near copies, shared passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; between stages ``docs`` is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally.llm.decontamination import decontaminate
from jobtally.llm.language import keep_identified
from jobtally.llm.packing import pack_documents
from jobtally.llm.queries import fold, table
from jobtally.llm.simhash import deduplicate_near
from jobtally.llm.substrings import deduplicate_substrings
from jobtally.llm.tokens import default_path
from jobtally.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go."""
    return keep_identified(docs, train=fold("doc_id", 4) != 2)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest id stays."""
    return deduplicate_near(docs)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand anywhere else too are cut out; ``n_chars`` follows the text."""
    cut = deduplicate_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share at least a twentieth of their words with benchmark items go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 4096."""
    return pack_documents(docs, default_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("shared_passages", shared_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

ORACLE_SQL = None  # kernels, XXH64 and a tokenizer are beyond SQL; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
