"""Series of daily metrics over a range of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The metrics followed over a period and their titles.
PERIOD_METRICS = {
    "Taux d'occupation de la RAM": (
        "Taux d'occupation de la RAM (% de la capacité totale en GB.secondes)"
    ),
    "Pourcentage d'utilisation CPU": (
        "Taux d'utilisation des CPUs (% de la capacité totale en CPU.secondes)"
    ),
}


def in_period(df: DataFrame, from_date: str, to_date: str) -> DataFrame:
    """Rows dated in the range, both ends included; prunes date partitions."""
    first, last = F.lit(from_date).cast("date"), F.lit(to_date).cast("date")
    return df.where(F.col("date").between(first, last))


def metric_series(days: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """``(date, metric, value)`` from one ``metrics`` map per day; absent counts as 0."""
    names = metrics or list(PERIOD_METRICS)
    return days.select(
        "date", F.explode(F.array(*[F.lit(n) for n in names])).alias("metric"), "metrics"
    ).select(
        "date",
        "metric",
        F.coalesce(F.try_element_at("metrics", F.col("metric")), F.lit(0.0)).alias("value"),
    )


def metric_maps(global_metrics: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One map of labelled numbers per day from the global rows of the daily table."""
    entries = [
        x for column, label in labels.items()
        for x in (F.lit(label), F.col(column).cast("double"))
    ]
    return global_metrics.select("date", F.create_map(*entries).alias("metrics"))


def chronological(series: DataFrame) -> DataFrame:
    return series.orderBy("date", "metric")


def series_range(series: DataFrame) -> DataFrame:
    return series.groupBy("metric").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def days_with_data(days: DataFrame) -> DataFrame:
    return days.agg(F.count_if(F.size("metrics") > 0).alias("num_days"))
