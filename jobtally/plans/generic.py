"""Allocations with memory and CPU efficiency: the table all reports start from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import columns
from ..operators.allocations import aggregate_per_alloc
from ..sources.clustered import ClusteredTable


def generic_report(
    accounting: DataFrame | ClusteredTable, group_by: str | list[str] = "JobRoot", decimals: bool = False
) -> DataFrame:
    """Classify rows, parse sizes, collapse steps to allocations, add efficiencies.

    Everything but the collapse is row by row, so the whole report shuffles once,
    on ``group_by``. Use ``["date", "JobRoot"]`` for tables of many days. A
    clustered table is not shuffled but for its crowded jobs.
    """
    if isinstance(accounting, ClusteredTable):
        return accounting.per_job(lambda rows: generic_report(rows, group_by, decimals))
    return (
        accounting.transform(columns.add_job_columns)
        .transform(columns.parse_size, "MaxRSS", decimals)
        .transform(columns.parse_size, "ReqMem", decimals)
        .transform(aggregate_per_alloc, group_by)
        .transform(columns.add_memory_efficiency)
        .transform(columns.add_cpu_seconds)
        .transform(columns.add_cpu_efficiency)
    )
