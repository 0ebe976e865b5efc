"""Daily metrics from accounting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columns
from ..operators.daily import daily_metrics
from ..sources.accounting import scan_day
from ..sources.sinks import write_daily_json
from .generic import generic_report


def daily_report(
    accounting: DataFrame,
    capacity: dict[str, int] | DataFrame | None = None,
    exact_gb: bool = False,
    day: str | None = None,
) -> DataFrame:
    """Metrics of every date in ``accounting``, overall and per QOS, in one job.

    Only the columns the metrics read leave the scan. A job is collapsed within
    each date: a date is the day its rows were dumped for. To report some days,
    filter ``accounting`` by ``date``; a filter on the result reads every day.
    ``day`` takes all rows as the dump of that one day.
    """
    if day is not None:
        accounting = accounting.withColumn("date", F.lit(day).cast("date"))
    return (
        generic_report(accounting, ["date", "JobRoot"])
        .transform(columns.add_moments)
        .transform(columns.add_wait_time)
        .transform(columns.add_job_duration)
        .transform(daily_metrics, capacity, exact_gb)
    )


def daily_report_of_day(
    spark: SparkSession,
    folder: str,
    day: str,
    json_folder: str | None = None,
    capacity: dict[str, int] | DataFrame | None = None,
) -> DataFrame:
    """Metrics of one ``<date>.parquet`` file, also written as JSON when asked."""
    metrics = daily_report(scan_day(spark, folder, day), capacity)
    if json_folder:
        write_daily_json(metrics, json_folder)
    return metrics


def daily_hours(accounting: DataFrame, day: str) -> DataFrame:
    """Allocations with the hours each ran on ``day``."""
    return generic_report(accounting.drop("date")).transform(
        columns.add_daily_duration, F.lit(day).cast("date")
    )
