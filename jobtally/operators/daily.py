"""Daily cluster metrics, overall and per quality-of-service class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers, times
from .columns import MOMENTS, moment, rename_columns

# Default capacity of a day, in CPU seconds and GB seconds.
DEFAULT_CAPACITY = {
    "cpu_secondes": 96 * 86400 * 4 + 40 * 86400,
    "gb_secondes": 2183 * 86400,
}

# Report labels of the daily metrics, in report order.
METRIC_LABELS = {
    "cpu_seconds": "CPU.Secondes",
    "cpu_hours": "CPU.Heures",
    "cpu_percent": "Pourcentage d'utilisation CPU",
    "gb_seconds": "GB.Secondes",
    "ram_percent": "Taux d'occupation de la RAM",
    "wait_mean": "Temps d'attente moyen en queue (secondes)",
    "wait_median": "Temps d'attente médian en queue (secondes)",
    "wait_min": "Temps d'attente minimum en queue (secondes)",
    "wait_max": "Temps d'attente maximum en queue (secondes)",
    "submitted": "Jobs soumis",
    "started": "Jobs démarrés",
    "ended": "Jobs terminés",
    "succeeded": "Jobs terminés avec succès",
    "failed": "Jobs échoués",
    "preempted": "Jobs préemptés",
    "duration_mean": "Durée moyenne d'exécution (secondes)",
    "duration_median": "Durée médiane d'exécution (secondes)",
    "duration_min": "Durée minimum d'exécution (secondes)",
    "duration_max": "Durée maximum d'exécution (secondes)",
}
METRICS = list(METRIC_LABELS)


def _capacity_columns(
    df: DataFrame, capacity: dict[str, int] | DataFrame | None
) -> tuple[DataFrame, Column, Column]:
    """``df`` with its capacity; an entry not given counts as 1."""
    if isinstance(capacity, DataFrame):
        # One row per date joined to one row per date and class: both are small.
        joined = df.join(capacity.select("date", "cpu_secondes", "gb_secondes"), "date", "left")
        cpu, gb = F.coalesce("cpu_secondes", F.lit(1)), F.coalesce("gb_secondes", F.lit(1))
        return joined, cpu.cast("double"), gb.cast("double")
    amounts = DEFAULT_CAPACITY if capacity is None else capacity
    cpu, gb = amounts.get("cpu_secondes", 1), amounts.get("gb_secondes", 1)
    return df, F.lit(float(cpu)), F.lit(float(gb))


def daily_metrics(
    allocations: DataFrame,
    capacity: dict[str, int] | DataFrame | None = None,
    exact_gb: bool = False,
) -> DataFrame:
    """The daily metrics of any number of days: a row per date and per date and QOS.

    ``allocations`` holds one row per date and allocation. Both groupings come
    from one pass over it. Waits and durations are whole seconds, so the medians'
    buffers are bounded by the distinct seconds of a day's jobs, not by their
    number. Memory occupancy counts whole GB unless ``exact_gb``.
    """
    submit, start, end = (moment(allocations, c) for c in MOMENTS)
    is_job = F.col("JobID").isNotNull()
    elapsed = F.col("ElapsedRaw").cast("double")
    gb = numbers.bytes_to_gb(F.col("MaxRSS"))
    counted_gb = gb if exact_gb else F.expr(f"MaxRSS div {numbers.BYTES_PER_GB}").cast("double")
    wait = F.col("wait_time_seconds")
    duration = F.col("job_duration_seconds")

    narrow = allocations.select(
        "date",
        "QOS",
        "TotalCPU_seconds",
        (gb * elapsed).alias("gb_seconds"),
        (counted_gb * elapsed).alias("counted_gb_seconds"),
        "wait_time_seconds",
        "job_duration_seconds",
        (is_job & (F.to_date(submit) == F.col("date"))).alias("is_submitted"),
        (is_job & (F.to_date(start) == F.col("date"))).alias("is_started"),
        (is_job & (F.to_date(end) == F.col("date"))).alias("is_ended"),
        (is_job & (F.col("State") == "COMPLETED")).alias("is_succeeded"),
        (is_job & (F.col("State") == "FAILED")).alias("is_failed"),
        (is_job & (F.col("State") == "PREEMPTED")).alias("is_preempted"),
    )
    states = ("submitted", "started", "ended", "succeeded", "failed", "preempted")
    grouped = narrow.groupingSets([["date"], ["date", "QOS"]], "date", "QOS").agg(
        F.grouping_id().alias("_level"),
        F.coalesce(F.sum("TotalCPU_seconds"), F.lit(0)).alias("cpu_seconds"),
        F.coalesce(F.sum("gb_seconds"), F.lit(0.0)).alias("gb_seconds"),
        F.coalesce(F.sum("counted_gb_seconds"), F.lit(0.0)).alias("counted_gb_seconds"),
        F.avg(wait).alias("wait_mean"),
        F.median(wait).alias("wait_median"),
        F.min(wait).alias("wait_min"),
        F.max(wait).alias("wait_max"),
        *[F.count_if(F.col(f"is_{s}")).alias(s) for s in states],
        F.avg(duration).alias("duration_mean"),
        F.median(duration).alias("duration_median"),
        F.min(duration).alias("duration_min"),
        F.max(duration).alias("duration_max"),
    )
    grouped, cpu_capacity, gb_capacity = _capacity_columns(grouped, capacity)
    cpu = F.col("cpu_seconds").cast("double")
    return grouped.select(
        "date",
        F.when(F.col("_level") == 0, "qos").otherwise("global").alias("scope"),
        "QOS",
        "cpu_seconds",
        (cpu / F.lit(3600.0)).alias("cpu_hours"),
        (numbers.ieee_divide(cpu, cpu_capacity) * F.lit(100.0)).alias("cpu_percent"),
        "gb_seconds",
        (numbers.ieee_divide(F.col("counted_gb_seconds"), gb_capacity) * F.lit(100.0)).alias(
            "ram_percent"
        ),
        *METRICS[METRICS.index("wait_mean"):],
    )


def with_report_labels(metrics: DataFrame) -> DataFrame:
    return rename_columns(
        metrics, {"date": "date", "scope": "scope", "QOS": "QOS", **METRIC_LABELS}
    )


def displayed(metrics: DataFrame) -> DataFrame:
    """The metrics as a reader sees them: two decimals, times in hours to seconds."""
    shown = {}
    for name in METRICS:
        if name.startswith(("wait_", "duration_")):
            shown[name] = times.format_duration(F.col(name))
        elif name in ("cpu_hours", "cpu_percent", "gb_seconds", "ram_percent"):
            shown[name] = numbers.round_half_away(F.col(name), 2)
    return metrics.withColumns(shown).transform(with_report_labels)


def global_rows(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("scope") == "global").drop("scope", "QOS")


def qos_rows(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("scope") == "qos").drop("scope")
