"""Column expressions for the quantities that accounting rows carry as text.

Patterns use ``[0-9]`` and ``\\z``, and ``(?d)`` so that only a line feed ends a
line: Java's ``\\d``, ``$`` and ``.`` otherwise differ from the formats meant here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Comment and identifier formats.
JOB_ROOT = r"^([0-9]+)"
JOB_SUFFIX = r"(?d)^[0-9]+\.(.+)\z"
RULE_WITH_WILDCARDS = r"(?d)^rule_(.+?)_wildcards_(.+)\z"
RULE_ONLY = r"(?d)^rule_(.+)\z"
SIZE_WITH_UNIT = r"([0-9]+)([KMGT])"
SIZE_WITH_UNIT_DECIMAL = r"([0-9]+(?:\.[0-9]+)?)([KMGT])"
CPU_DAYS = r"^([0-9]+)-([0-9]+):([0-9]+):([0-9]+)\z"
CPU_HOURS = r"^([0-9]+):([0-9]+):([0-9]+)\z"
CPU_FRACTION = r"^([0-9]+):([0-9]+)\.[0-9]+\z"
PROJECT_LOG = r"(?d)^(.*)/\.snakemake/log/[^/]+\z"

# Bytes per unit.
UNIT_BYTES = {"K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that is null, not empty, when the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def job_root(job_id: Column) -> Column:
    return extract_or_null(job_id, JOB_ROOT)


def job_suffix(job_id: Column) -> Column:
    return extract_or_null(job_id, JOB_SUFFIX)


def job_info_type(suffix: Column) -> Column:
    """Kind of accounting row, from what follows the dot of its ``JobID``."""
    return (
        F.when(suffix.isNull(), "allocation")
        .when(suffix.isin("batch", "extern"), suffix)
        .when(suffix.rlike(r"^[0-9]+\z"), "step")
        .otherwise("unknown")
    )


def rule_name(comment: Column) -> Column:
    """Rule named in a job comment; empty text when the comment names none."""
    return (
        F.when(
            comment.rlike(r"(?d)^rule_.+?_wildcards_.+"),
            extract_or_null(comment, RULE_WITH_WILDCARDS, 1),
        )
        .when(comment.rlike("^rule_"), extract_or_null(comment, RULE_ONLY))
        .otherwise("")
    )


def wildcards(comment: Column) -> Column:
    return F.coalesce(extract_or_null(comment, RULE_WITH_WILDCARDS, 2), F.lit(""))


def size_number(c: Column, decimals: bool = False) -> Column:
    return extract_or_null(c, SIZE_WITH_UNIT_DECIMAL if decimals else SIZE_WITH_UNIT, 1)


def size_unit(c: Column, decimals: bool = False) -> Column:
    return extract_or_null(c, SIZE_WITH_UNIT_DECIMAL if decimals else SIZE_WITH_UNIT, 2)


def size_bytes(number: Column, unit: Column, decimals: bool = False) -> Column:
    """Bytes of ``number`` in ``unit``; 0 for a missing or other unit."""
    if decimals:
        value = number.try_cast("decimal(28,10)")
        scaled = {u: F.floor(value * F.lit(n)).try_cast("bigint") for u, n in UNIT_BYTES.items()}
    else:
        value = number.try_cast("bigint")
        scaled = {u: F.try_multiply(value, F.lit(n).cast("bigint")) for u, n in UNIT_BYTES.items()}
    result = F
    for u, amount in scaled.items():
        result = result.when(unit == u, amount)
    return result.otherwise(F.lit(0).cast("bigint"))


def cpu_seconds(c: Column) -> Column:
    """Whole seconds of ``D-HH:MM:SS``, ``HH:MM:SS`` or ``MM:SS.fff``; 0 for all else.

    A text is matched once; its numbers are then what stands between the marks.
    """

    def total(*weighted: tuple[Column, int]) -> Column:
        parts = [text.try_cast("bigint") * F.lit(w).cast("bigint") for text, w in weighted]
        return sum(parts[1:], parts[0])

    def clock(text: Column) -> list[tuple[Column, int]]:
        minutes = F.substring_index(F.substring_index(text, ":", 2), ":", -1)
        return [(F.substring_index(text, ":", 1), 3600), (minutes, 60), (F.substring_index(text, ":", -1), 1)]

    day, time = F.substring_index(c, "-", 1), F.substring_index(c, "-", -1)
    whole = F.substring_index(c, ".", 1)
    return (
        F.when(c.rlike(CPU_DAYS), total((day, 86400), *clock(time)))
        .when(c.rlike(CPU_HOURS), total(*clock(c)))
        .when(
            c.rlike(CPU_FRACTION),
            total((F.substring_index(whole, ":", 1), 60), (F.substring_index(whole, ":", -1), 1)),
        )
        .otherwise(F.lit(0).cast("bigint"))
    )


def trim_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))


def project_dir(log_path: Column) -> Column:
    """Folder a workflow ran in, from the path of its log; null for other paths."""
    folder = F.regexp_extract(log_path, PROJECT_LOG, 1)
    return F.when(log_path.rlike(PROJECT_LOG), F.when(folder == "", "/").otherwise(folder))


def join_path(folder: Column, path: Column) -> Column:
    return F.concat(F.when(folder == "/", "").otherwise(folder), F.lit("/"), path)
