"""Efficiency of workflow runs, per rule."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import columns, inputs, rules
from ..session import in_parts, materialize, new_folder, shuffles_removed
from ..sources.sinks import write_parquet
from .generic import generic_report

STATISTICS = ("mean", "median", "std", "min", "max")

# Report tables, their metric and the labels of its five statistics.
TABLE_LABELS = {
    "mem": (
        "MemEfficiencyPercent",
        "Efficacité mémoire moyenne",
        "Efficacité mémoire médiane",
        "Efficacité mémoire (écart-type)",
        "Efficacité mémoire minimum",
        "Efficacité mémoire maximum",
    ),
    "cpu": (
        "CPUEfficiencyPercent",
        "Efficacité CPU moyenne",
        "Efficacité CPU médiane",
        "Efficacité CPU (écart-type)",
        "Efficacité CPU minimum",
        "Efficacité CPU maximum",
    ),
    "runtime": (
        "ElapsedRaw",
        "Durée moyenne",
        "Durée médiane",
        "Durée (écart-type)",
        "Durée minimum",
        "Durée maximum",
    ),
    "relative_mem": (
        "UsedRAMPerMo",
        "RAM utilisée par Mo (moyenne)",
        "RAM utilisée par Mo (médiane)",
        "RAM utilisée par Mo (écart-type)",
        "RAM utilisée par Mo (minimum)",
        "RAM utilisée par Mo (maximum)",
    ),
    "relative_runtime": (
        "MinPerMo",
        "Minutes par Mo (moyenne)",
        "Minutes par Mo (médiane)",
        "Minutes par Mo (écart-type)",
        "Minutes par Mo (minimum)",
        "Minutes par Mo (maximum)",
    ),
}
RULE_LABEL = "Nom de la règle"
# The rows of a report are collapsed in so many parts, one after the other.
PARTS = 4


class RuleReport:
    """The stored allocations of a report, and its tables, each found when it is first asked for.

    The quartiles are found once for the statistics and the distributions, and the
    statistics are stored, as every table shows a part of them.
    """

    def __init__(self, allocations: DataFrame, with_sizes: bool) -> None:
        self.allocations = allocations
        self._with_sizes = with_sizes
        self._wanted = list(TABLE_LABELS) if with_sizes else ["mem", "cpu", "runtime"]
        self._metrics = [TABLE_LABELS[t][0] for t in self._wanted]

    @cached_property
    def _quartiles(self) -> DataFrame:
        return materialize(rules.rule_quartiles(self.allocations, self._metrics))

    @cached_property
    def statistics(self) -> DataFrame:
        return materialize(rules.aggregate_per_rule(self.allocations, self._with_sizes, self._quartiles))

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {t: labelled_table(self.statistics, t) for t in self._wanted}

    @cached_property
    def distributions(self) -> DataFrame:
        """A row per metric and rule."""
        return rules.rule_distributions(self.allocations, self._metrics, self._quartiles)


def run_allocations(
    accounting: DataFrame,
    run_ids: list[str] | DataFrame | None,
    sizes: DataFrame | None = None,
    match: str = "all",
) -> DataFrame:
    """Allocations of the runs with rule columns, joined to input sizes if given.

    ``run_ids`` as a table (column ``run_id``) is semi-joined; ``None`` keeps all.
    Rows of other jobs are left out before the collapse, so that only the runs'
    jobs are shuffled; the accounting table's ids and names are read for that.
    """
    return _allocations(_rows_of_runs(accounting, run_ids, match), run_ids, sizes, match)


def _rows_of_runs(accounting: DataFrame, run_ids: list[str] | DataFrame | None, match: str) -> DataFrame:
    if run_ids is None:
        return accounting
    jobs = columns.add_job_columns(accounting)
    return rules.rows_of_runs(jobs, run_ids, match).select(*accounting.columns)


def _allocations(
    rows: DataFrame, run_ids: list[str] | DataFrame | None, sizes: DataFrame | None, match: str
) -> DataFrame:
    allocations = generic_report(rows)
    if isinstance(run_ids, DataFrame):
        allocations = rules.filter_runs_in(allocations, run_ids)
    elif run_ids is not None:
        allocations = rules.filter_runs(allocations, run_ids, match)
    allocations = columns.add_rule_columns(allocations)
    return allocations if sizes is None else inputs.enrich_with_input_sizes(allocations, sizes)


def labelled_table(statistics: DataFrame, table: str) -> DataFrame:
    """One of the report tables, by rule name, rules without a name first."""
    metric, *labels = TABLE_LABELS[table]
    names = {f"{metric}_{s}": label for s, label in zip(STATISTICS, labels)}
    renamed = columns.rename_columns(statistics, {"rule_name": RULE_LABEL, **names})
    return renamed.orderBy(F.col(f"`{RULE_LABEL}`").asc_nulls_first())


def displayed_table(table: DataFrame) -> DataFrame:
    """A report table as a reader sees it: three decimals, and the band of each cell."""
    names = [c for c in table.columns if c != RULE_LABEL]
    banded = columns.add_bands(table, names)
    return columns.round_doubles(banded, 3)


def rule_report(
    accounting: DataFrame,
    run_ids: list[str] | DataFrame | None,
    sizes: DataFrame | None = None,
    match: str = "all",
    output: str | None = None,
) -> RuleReport:
    """All tables of the per-rule report.

    The allocations are computed once: written to ``output`` and read back from
    there, or kept in the checkpoint folder. Rows of many columns are shuffled for
    that two times, so they are stored and taken in parts, a job whole in one of them.
    """
    spark = accounting.sparkSession
    path = output or new_folder(spark)
    if sizes is not None:
        sizes = materialize(sizes.select("slurm_jobid", "input_size_bytes", "inputs"), "zstd")
    if isinstance(run_ids, DataFrame):
        run_ids = materialize(run_ids.select("run_id").distinct())
    rows = columns.add_job_columns(_rows_of_runs(accounting, run_ids, match))
    mode = "errorifexists"
    for part in in_parts(rows, F.pmod(F.hash("JobRoot"), F.lit(PARTS))):
        allocations = _allocations(part, run_ids, sizes, match)
        with shuffles_removed(spark):
            write_parquet(allocations, path, mode)
        mode = "append"
    return RuleReport(spark.read.schema(allocations.schema).parquet(path), sizes is not None)
