"""Daily metrics followed over a period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import period
from ..operators.daily import METRIC_LABELS, global_rows
from ..session import materialize
from ..sources.reports import scan_daily_json
from .daily_report import daily_report


@dataclass(frozen=True)
class PeriodReport:
    series: DataFrame  # date, metric, title, value; in date order
    ranges: DataFrame  # metric, title, min_value, max_value
    num_days: DataFrame  # one row


def _with_titles(df: DataFrame) -> DataFrame:
    entries = [F.lit(x) for item in period.PERIOD_METRICS.items() for x in item]
    return df.withColumn("title", F.create_map(*entries)[F.col("metric")])


def period_report(days: DataFrame, from_date: str, to_date: str) -> PeriodReport:
    """From one map of overall metrics per day: ``(date, metrics)``."""
    chosen = period.in_period(days, from_date, to_date)
    series = period.metric_series(chosen)
    return PeriodReport(
        period.chronological(_with_titles(series)),
        _with_titles(period.series_range(series)),
        period.days_with_data(chosen),
    )


def period_report_from_metrics(
    daily: DataFrame, from_date: str, to_date: str, stored: bool = True
) -> PeriodReport:
    """From the daily table, without documents in between.

    The three tables of the report each read the days; these are computed once and
    stored, a row a day, before they do. Unless ``stored``, each computes them anew.
    """
    labels = {c: label for c, label in METRIC_LABELS.items() if label in period.PERIOD_METRICS}
    days = period.metric_maps(global_rows(daily), labels)
    return period_report(materialize(days) if stored else days, from_date, to_date)


def period_report_from_accounting(
    accounting: DataFrame,
    from_date: str,
    to_date: str,
    capacity: dict[str, int] | DataFrame | None = None,
    stored: bool = False,
) -> PeriodReport:
    """From accounting rows: only the partitions of the period are read.

    ``stored`` as in :func:`period_report_from_metrics`: worth it when several tables of the report are read.
    """
    chosen = period.in_period(accounting, from_date, to_date)
    return period_report_from_metrics(daily_report(chosen, capacity), from_date, to_date, stored)


def period_report_from_json(
    spark: SparkSession, folder: str, from_date: str, to_date: str
) -> PeriodReport:
    return period_report(scan_daily_json(spark, folder, from_date, to_date), from_date, to_date)
