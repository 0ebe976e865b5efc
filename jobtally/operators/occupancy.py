"""Hours of running jobs by day, from what changes when jobs start and end.

A job gives at most four changes, however many days it runs: the part of its first day and of its
last one, and where it begins and ceases to fill whole days. Changes are added up by day and key
before they are shuffled, and a running sum over the days of a key restores the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times
from .columns import MOMENTS, moment

WHOLE_DAY = 86400  # seconds of a day that a job fills; one that starts or ends a job ends at 23:59:59


def _change(date: Column, seconds: Column | int, filling: int, present: int) -> Column:
    number = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.struct(
        date.alias("date"), number.cast("bigint").alias("seconds"),
        F.lit(filling).cast("bigint").alias("filling"), F.lit(present).cast("bigint").alias("present"),
    )


def job_changes(jobs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """What jobs add to a day by ``keys``: seconds of that day alone, whole-day jobs and jobs from it on.

    ``weight`` multiplies the time of a job, whole numbers such as its CPUs; null counts 0.
    Jobs with an unknown time, or that end on a day before they start, add nothing.
    """
    _, start, end = (moment(jobs, c) for c in MOMENTS)
    held = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    spans = jobs.select(
        *keys, start.alias("_start"), end.alias("_end"), F.to_date(start).alias("_first"), F.to_date(end).alias("_last"),
        held.cast("bigint").alias("_held"),
    ).where(F.col("_first") <= F.col("_last"))
    first, last = F.col("_first"), F.col("_last")
    midnight = last.cast("timestamp_ntz")
    day_end = first.cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")
    same_day = F.array(
        _change(first, times.seconds_between(F.col("_start"), F.col("_end")), 0, 1), _change(F.date_add(first, 1), 0, 0, -1)
    )
    more_days = F.array(
        _change(first, times.seconds_between(F.col("_start"), day_end), 0, 1),
        _change(F.date_add(first, 1), 0, 1, 0),
        _change(last, times.seconds_between(midnight, F.col("_end")), -1, 0),
        _change(F.date_add(last, 1), 0, 0, -1),
    )
    changes = spans.select(*keys, "_held", F.inline(F.when(first == last, same_day).otherwise(more_days)))
    return changes.groupBy(*keys, "date").agg(
        F.sum(F.col("seconds") * F.col("_held")).alias("seconds"),
        F.sum(F.col("filling") * F.col("_held")).alias("filling"),
        F.sum("present").alias("present"),
    )


def merge_changes(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Changes of several sets of jobs, such as stored ones and those of a new dump, as of all their jobs."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in ("seconds", "filling", "present")])


def occupied_days(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and day that any job touches: ``running_jobs`` and ``hours``, all days of the calendar between.

    The window holds the days of a key that bear a change, not its jobs. Only days between two changes are
    spread over the calendar, as their totals are alike.
    """
    days = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("date")
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    summed = changes.select(
        *keys, "date", "seconds", F.sum("filling").over(so_far).alias("_filling"), F.sum("present").over(so_far).alias("running_jobs"),
        F.date_sub(F.lead("date").over(days), 1).alias("_until"),
    ).where(F.col("running_jobs") > 0)  # the last change of a key leaves no job, so the others have a next one
    calendar = summed.select(
        *keys, "seconds", "_filling", "running_jobs", F.col("date").alias("_from"),
        F.explode(F.sequence("date", "_until")).alias("date"),
    )
    own = F.when(F.col("date") == F.col("_from"), F.col("seconds")).otherwise(F.lit(0))
    hours = (own + F.col("_filling") * F.lit(WHOLE_DAY)).cast("double") / F.lit(3600.0)
    return calendar.select(*keys, "date", "running_jobs", hours.alias("hours"))


def daily_occupancy(jobs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """``running_jobs`` and ``hours`` of all jobs by ``keys`` and day: the totals of ``explode_job_days``."""
    return occupied_days(job_changes(jobs, keys, weight), keys)
