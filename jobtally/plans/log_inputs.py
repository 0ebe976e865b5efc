"""Input sizes of workflow jobs, from logs and a manifest of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import inputs, logs
from ..sources.logs import read_log_pieces


def log_input_sizes(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Size table of all logs in one job: ids, rule, total input size, input paths."""
    return inputs.input_sizes(logs.log_records(lines), manifest)


def log_input_sizes_of_texts(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    return inputs.input_sizes(logs.log_records_of_texts(texts), manifest)


def log_input_sizes_of_files(
    spark: SparkSession, log_paths: list[str], manifest: DataFrame
) -> DataFrame:
    """Each log is read once, split at its records."""
    return inputs.input_sizes(logs.log_records_of_pieces(read_log_pieces(spark, log_paths)), manifest)
