"""Reading workflow logs as lines or as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .paths import existing_paths, plain_path

LINES_SCHEMA = "log_path string, block bigint, row bigint, line string"
PIECES_SCHEMA = "log_path string, block bigint, row bigint, piece string"


def read_log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of logs: ``(log_path, block, row, line)``; absent logs are passed over.

    A path may be a file-system pattern.

    Files are split like any text: ``block`` is the offset of the piece a line was
    read from, ``row`` increases along it.
    """
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], LINES_SCHEMA)
    return (
        spark.read.options(lineSep="\n", ignoreMissingFiles=True)
        .text(found)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("log_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.regexp_replace("value", r"\r\z", "").alias("line"),
        )
    )


def read_log_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Logs cut where a line opens with ``[``: ``(log_path, block, row, piece)``; absent logs are passed over.

    The reader takes line feed and bracket as its delimiter, so a record comes whole out of the
    scan, in one task, however the file is split; the delimiter is not part of a piece. A log's
    first piece is all up to its second such line, or its preamble. ``row`` counts up by one
    within a block. A piece is one value, so a stretch of 2 GB without such a line does not
    fit; :func:`read_log_lines` reads that.
    """
    found = existing_paths(spark, paths)
    if not found:
        return spark.createDataFrame([], PIECES_SCHEMA)
    return (
        spark.read.options(lineSep="\n[", ignoreMissingFiles=True)
        .text(found)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("log_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.replace(F.regexp_replace("value", r"\r\z", ""), F.lit("\r\n"), F.lit("\n")).alias("piece"),
        )
    )


def read_log_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Short logs one per row: ``(log_path, content)``."""
    return spark.read.text(paths, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("log_path"), F.col("value").alias("content")
    )


def lines_of_texts(texts: DataFrame) -> DataFrame:
    """The same shape from a table ``(log_path, content)`` of short logs."""
    content = F.regexp_replace("content", r"\r?\n\z", "")
    return texts.where(F.col("content") != "").select(
        "log_path",
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split(content, "\r?\n", -1)).alias("row", "line"),
    ).select("log_path", "block", F.col("row").cast("bigint").alias("row"), "line")
