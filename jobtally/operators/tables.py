"""Whole-table operators: union by name, run days, malformed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ACCOUNTING_COLUMNS, accounting_cast

SEPARATOR = "|"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of ``frames``; a column absent from one is null there.

    Accounting columns are cast to their types first: a plain union would turn a
    text column that is integer elsewhere into integers.
    """
    typed = [df.select(*[accounting_cast(df, c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)


def rows_of_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows dated on one of ``dates``.

    Distinct calendar dates are few by nature, so Spark will broadcast them, which
    also prunes date partitions; there is no hint, should there be more.
    """
    wanted = dates.select("date").distinct()
    return df.join(wanted, "date", "left_semi")


def split_fields(line: Column, separator: str = SEPARATOR) -> Column:
    return F.split(line, f"\\{separator}" if len(separator) == 1 else f"\\Q{separator}\\E", -1)


def field_count(line: Column, separator: str = SEPARATOR) -> Column:
    """Number of fields, counted without splitting the line."""
    removed = F.length(line) - F.length(F.replace(line, F.lit(separator), F.lit("")))
    return removed / F.lit(len(separator)) + 1


def drop_malformed_lines(
    lines: DataFrame, column_count: int = len(ACCOUNTING_COLUMNS), separator: str = SEPARATOR
) -> DataFrame:
    return lines.where(field_count(F.col("line"), separator) == column_count)


def count_malformed_lines(
    lines: DataFrame, column_count: int = len(ACCOUNTING_COLUMNS), separator: str = SEPARATOR
) -> DataFrame:
    kept = field_count(F.col("line"), separator) == column_count
    return lines.agg(
        F.count_if(~kept).alias("removed_lines"), F.count_if(kept).alias("kept_lines")
    )
