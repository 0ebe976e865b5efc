"""File manifests and input-size tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import INPUT_SIZE_SCHEMA
from .paths import plain_path


def scan_file_sizes(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """Manifest ``(path, length)`` of stored files; their content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(paths)
    )
    return files.select(plain_path(F.col("path")).alias("path"), "length")


def read_input_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INPUT_SIZE_SCHEMA).options(sep="|", header=True).csv(path)
