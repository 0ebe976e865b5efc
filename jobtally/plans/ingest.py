"""From pipe-delimited dumps to the accounting table by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.tables import count_malformed_lines, drop_malformed_lines, field_count
from ..schema import ACCOUNTING_COLUMNS
from ..sources.accounting import FILE_DATE, parse_dump_lines, read_dump_lines
from ..sources.sinks import write_accounting_table


def typed_rows(lines: DataFrame, reject: bool = False) -> DataFrame:
    """Accounting rows of the well-formed lines of dumps."""
    return drop_malformed_lines(lines).transform(parse_dump_lines, reject)


def dated_rows(lines: DataFrame, day: str | None = None, reject: bool = False) -> DataFrame:
    """Typed rows with ``date``: ``day``, or the date in the dump's file name.

    A dump without either is an error.
    """
    named = F.lit(day) if day else F.regexp_extract("file_name", FILE_DATE, 1)
    missing = F.concat(F.lit("no date for dump "), "file_name")
    date = F.coalesce(named.try_cast("date"), F.raise_error(missing).cast("date"))
    return typed_rows(lines, reject).withColumn("date", date).drop("file_name")


def ingest(
    spark: SparkSession,
    dumps: str | list[str],
    table: str,
    day: str | None = None,
    reject: bool = False,
    replace_days: bool = False,
    recount: bool = False,
) -> int:
    """Write dumps to the accounting table; returns the number of lines removed.

    Lines are counted as they are written. A task that runs again because an
    executor was lost may count its lines twice; ``recount`` reads the dumps a second
    time for a number that is exact in any case. What is written is exact either way.
    """
    lines = read_dump_lines(spark, dumps)
    seen = Observation()
    kept = field_count(F.col("line")) == len(ACCOUNTING_COLUMNS)
    counted = lines.observe(seen, F.count_if(~kept).alias("removed_lines"))
    write_accounting_table(dated_rows(counted, day, reject), table, replace_days)
    return count_malformed_lines(lines).first()["removed_lines"] if recount else seen.get["removed_lines"]
