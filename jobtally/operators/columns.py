"""Derived columns: each function adds or replaces columns of an accounting table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers, text, times


def add_job_columns(df: DataFrame) -> DataFrame:
    """``JobRoot`` (the allocation's id) and ``JobInfoType`` from ``JobID``; a table that has both keeps them."""
    if {"JobRoot", "JobInfoType"} <= set(df.columns):
        return df
    job_id = F.col("JobID")
    # A column of its own, so that the pattern runs once per row.
    suffixed = df.withColumn("_suffix", text.job_suffix(job_id))
    return suffixed.withColumns(
        {"JobRoot": text.job_root(job_id), "JobInfoType": text.job_info_type(F.col("_suffix"))}
    ).drop("_suffix")


def add_rule_columns(df: DataFrame) -> DataFrame:
    comment = F.col("Comment")
    return df.withColumns(
        {"rule_name": text.rule_name(comment), "wildcards": text.wildcards(comment)}
    )


def split_size_unit(df: DataFrame, name: str, decimals: bool = False) -> DataFrame:
    """Replace a size such as ``4G`` by its number and put its unit in ``<name>_unit``."""
    size = F.col(name)
    return df.withColumns(
        {
            name: text.size_number(size, decimals),
            f"{name}_unit": text.size_unit(size, decimals),
        }
    )


def size_to_bytes(df: DataFrame, name: str, decimals: bool = False) -> DataFrame:
    return df.withColumn(name, text.size_bytes(F.col(name), F.col(f"{name}_unit"), decimals))


def bytes_to_gb(df: DataFrame, name: str, keep_original: bool = True) -> DataFrame:
    target = f"{name}_G" if keep_original else name
    return df.withColumn(target, numbers.bytes_to_gb(F.col(name)))


def parse_size(df: DataFrame, name: str, decimals: bool = False) -> DataFrame:
    """``name`` in bytes, with ``<name>_unit`` and ``<name>_G``."""
    return (
        df.transform(split_size_unit, name, decimals)
        .transform(size_to_bytes, name, decimals)
        .transform(bytes_to_gb, name)
    )


MOMENTS = ["Submit", "Start", "End"]


def add_moments(df: DataFrame) -> DataFrame:
    """``<name>_ts`` for the three times of a job, so that each text is parsed once."""
    return df.withColumns({f"{c}_ts": times.parse_timestamp(F.col(c)) for c in MOMENTS})


def moment(df: DataFrame, name: str) -> Column:
    """A job's time as a timestamp: the parsed column where ``df`` has it."""
    parsed = f"{name}_ts"
    return F.col(parsed) if parsed in df.columns else times.parse_timestamp(F.col(name))


def add_wait_time(df: DataFrame) -> DataFrame:
    submit, start = moment(df, "Submit"), moment(df, "Start")
    seconds = times.seconds_between(submit, start)
    return df.withColumns(
        {
            "wait_duration": start - submit,
            "wait_time_seconds": seconds,
            "wait_time_hours": seconds / F.lit(3600.0),
        }
    )


def add_job_duration(df: DataFrame) -> DataFrame:
    seconds = times.seconds_between(moment(df, "Start"), moment(df, "End"))
    return df.withColumn("job_duration_seconds", seconds.cast("double"))


def add_daily_duration(df: DataFrame, day: str | Column) -> DataFrame:
    """``daily_duration_hours`` of each job on ``day``, and ``date``."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    start = times.parse_timestamp(F.col("Start"))
    end = times.parse_timestamp(F.col("End"))
    return df.withColumns(
        {"daily_duration_hours": times.hours_on_day(start, end, day), "date": day}
    )


def explode_job_days(df: DataFrame) -> DataFrame:
    """One row per job and day it touches, with its hours on that day.

    The many-day form of ``add_daily_duration``: a narrow explode per job instead
    of a pass over the table per day. Jobs with an unknown time touch no day.
    """
    start = times.parse_timestamp(F.col("Start"))
    end = times.parse_timestamp(F.col("End"))
    first, last = F.to_date(start), F.to_date(end)
    days = F.when(first <= last, F.sequence(first, last))
    exploded = df.withColumn("date", F.explode(days))
    return exploded.withColumn(
        "daily_duration_hours", times.hours_on_day(start, end, F.col("date"))
    )


def add_cpu_seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("TotalCPU_seconds", text.cpu_seconds(F.col("TotalCPU")))


def add_memory_efficiency(df: DataFrame) -> DataFrame:
    ratio = numbers.ieee_divide(F.col("MaxRSS"), F.col("ReqMem"))
    return df.withColumns(
        {"MemEfficiencyRatio": ratio, "MemEfficiencyPercent": ratio * F.lit(100.0)}
    )


def add_cpu_efficiency(df: DataFrame) -> DataFrame:
    """CPU time used over CPU time held, in percent; 0 when both are zero."""
    ratio = numbers.ieee_divide(F.col("TotalCPU_seconds"), F.col("CPUTimeRAW"))
    return df.withColumn("CPUEfficiencyPercent", F.nanvl(ratio, F.lit(0.0)) * F.lit(100.0))


def add_size_relative(df: DataFrame, used_memory: bool = False) -> DataFrame:
    """Minutes and requested MB per MB of input.

    ``used_memory`` adds ``MaxRSSPerMo``, the same for memory really used.
    """
    input_mb = F.col("input_size_bytes") / F.lit(1048576.0)
    minutes = F.col("ElapsedRaw") / F.lit(60.0)
    added = {
        "MinPerMo": numbers.ieee_divide(minutes, input_mb),
        "UsedRAMPerMo": numbers.ieee_divide(F.col("ReqMem") / F.lit(1048576.0), input_mb),
    }
    if used_memory:
        added["MaxRSSPerMo"] = numbers.ieee_divide(F.col("MaxRSS") / F.lit(1048576.0), input_mb)
    return df.withColumns(added)


def add_bands(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``<label>_band`` for every banded report label in ``df``."""
    wanted = labels if labels is not None else [c for c in df.columns if c in numbers.BANDED_LABELS]
    return df.withColumns(
        {f"{c}_band": numbers.efficiency_band(F.col(f"`{c}`"), c) for c in wanted}
    )


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns(
        {c: numbers.round_half_away(F.col(f"`{c}`"), digits) for c in doubles}
    )


def rename_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Only the columns in ``labels``, in its order and under its names."""
    return df.select(*[F.col(f"`{c}`").alias(label) for c, label in labels.items()])
