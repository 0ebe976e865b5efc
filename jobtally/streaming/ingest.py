"""Accounting dumps ingested as they arrive, into the same table as the batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import dated_rows
from ..schema import SOURCE_COLUMN
from ..sources.accounting import scan_table
from ..sources.paths import existing_paths, plain_path
from ..sources.sinks import write_accounting_table


def stream_dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(line, file, block, file_name)``; the row number is added where a batch is written."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return lines.select(
        F.regexp_replace("value", r"\r\z", "").alias("line"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def write_batch(lines: DataFrame, table: str, day: str | None = None) -> None:
    """Adds the dumps of one micro-batch that the table does not hold yet.

    A batch that ran before, wholly or in part of its files, adds what is missing: rows
    know their file, and a write commits as a whole. Only the batch's dates of
    the table are read for that.
    """
    spark = lines.sparkSession
    place = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    rows = dated_rows(lines.withColumn(SOURCE_COLUMN, place).drop("file", "block"), day)
    if existing_paths(spark, [f"{table.rstrip('/')}/date=*"]):
        dates = [r["date"] for r in rows.select("date").distinct().collect()]
        file = F.col(f"{SOURCE_COLUMN}.file")
        held = scan_table(spark, table).where(F.col("date").isin(dates))
        held = held.select("date", file.alias("_file")).distinct()
        rows = rows.withColumn("_file", file).join(held, ["date", "_file"], "left_anti").drop("_file")
    write_accounting_table(rows, table)


def start_ingest(
    spark: SparkSession, dumps: str, table: str, checkpoint: str, day: str | None = None
) -> StreamingQuery:
    """Ingest the dumps that arrived since the last run, each exactly once.

    The same line filter, typing and table as the batch ingest, by the same
    writer, so that either sees what the other wrote. One ingest writes to a table at a time.
    """
    return (
        stream_dump_lines(spark, dumps)
        .writeStream.foreachBatch(lambda lines, _: write_batch(lines, table, day))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
