"""Accounting rows of the days workflow runs touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.logs import run_dates, run_dates_of_texts
from ..operators.tables import rows_of_dates
from ..sources.accounting import scan_day_files


def collect_run_days(accounting: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of a table partitioned by ``date``, on the dates stamped in the logs."""
    return rows_of_dates(accounting, run_dates(lines))


def collect_run_days_of_texts(accounting: DataFrame, texts: DataFrame) -> DataFrame:
    return rows_of_dates(accounting, run_dates_of_texts(texts))


def collect_run_day_files(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """The same over loose ``<date>.parquet`` files; none for any date is an error.

    The dates decide which files exist to be scanned, so they come to the driver:
    at most one per calendar day.
    """
    days = [str(row["date"]) for row in run_dates(lines).collect()]
    return scan_day_files(spark, folder, days)
