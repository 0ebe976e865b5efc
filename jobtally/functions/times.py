"""Column expressions on zone-less timestamps kept as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import extract_or_null

# Timestamp formats of accounting rows and workflow logs.
TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
# The first bracketed stamp of a line; its day in four groups, its time in range.
STAMP = (
    r"\[\s*([A-Za-z]{3})\s+([A-Za-z]{3})\s+([0-9]{1,2})\s+"
    r"(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:(?:[0-5]?[0-9]|60)\s+([0-9]{4})\]"
)
LOG_STAMP = rf"(?s)^[^\[\]]*{STAMP}.*\z"
LOG_STAMP_IN_TEXT = rf"(?md)^[^\[\]\n]*{STAMP}"
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def parse_timestamp(c: Column) -> Column:
    """Zone-less timestamp found in ``c``; null when there is none."""
    return extract_or_null(c, TIMESTAMP, 0).try_cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two zone-less timestamps, whatever the session zone."""
    return (end - start).cast("interval second").cast("bigint")


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end).cast("double") / F.lit(3600.0)


def hours_on_day(start: Column, end: Column, day: Column) -> Column:
    """Hours a job ran on ``day``, whose end is 23:59:59.

    The cases are tried in order and the last is 0, also for unknown times.
    """
    midnight = day.cast("timestamp_ntz")
    last_second = midnight + F.expr("interval '23:59:59' hour to second")
    starts_today = F.to_date(start) == day
    ends_today = F.to_date(end) == day
    starts_before = start < midnight
    ends_late = end >= last_second
    return (
        F.when(starts_today & ends_today, hours_between(start, end))
        .when(starts_before & ends_today, hours_between(midnight, end))
        .when(starts_today & ends_late, hours_between(start, last_second))
        .when(starts_before & ends_late, F.lit(24.0))
        .otherwise(F.lit(0.0))
    )


def has_log_stamp(line: Column) -> Column:
    """Whether the first ``[...]`` of a log line is like ``[Thu Mar  5 11:45:18 2026]``."""
    return line.rlike(LOG_STAMP)


def stamp_day(line: Column) -> Column:
    """Weekday, month, day and year of the stamp of a line that has one, as text."""
    return F.regexp_replace(line, LOG_STAMP, "$1 $2 $3 $4")


def day_date(day_text: Column) -> Column:
    """Date of a ``stamp_day``; null unless it is real and its weekday fits."""
    words = F.split(day_text, " ")
    at = F.instr(F.lit(MONTHS), F.upper(words[1]))
    month = F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0")
    day = F.concat_ws("-", words[3], month, F.lpad(words[2], 2, "0")).try_cast("date")
    fits = F.upper(F.date_format(day, "EEE")) == F.upper(words[0])
    return F.when((at % 3 == 1) & fits, day)


def format_duration(value: Column) -> Column:
    """``Xh Ym Zs``, ``Ym Zs`` or ``Zs``; ``N/A`` for negative or non-numeric values."""
    seconds = value.try_cast("double")
    clean = F.when(F.isnan(seconds), 0.0).otherwise(seconds)
    hours = F.floor(clean / 3600.0)
    minutes = F.floor((clean % 3600.0) / 60.0)
    rest = F.floor(clean % 60.0)
    return (
        F.when(seconds.isNull() | (seconds < 0), "N/A")
        .when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("m "), rest, F.lit("s")))
        .when(minutes > 0, F.concat(minutes, F.lit("m "), rest, F.lit("s")))
        .otherwise(F.concat(rest, F.lit("s")))
    )
