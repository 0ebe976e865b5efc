"""Workflow runs and rules: filters, statistics per rule, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import numbers
from .allocations import RUN_ID_LENGTH, first_non_null
from .quantiles import Quantile, attach_group_rows, exact_quantiles

EFFICIENCY_METRICS = ["MemEfficiencyPercent", "CPUEfficiencyPercent", "ElapsedRaw"]
SIZE_METRICS = ["UsedRAMPerMo", "MinPerMo"]
MATCHES = ("all", "any", "exact")


def run_condition(run_ids: list[str], match: str = "all") -> Column:
    """Whether ``JobName`` matches the run ids.

    ``all`` and ``any`` take each id as a regular expression found anywhere in
    the name; ``all`` wants every id to match, so two different ids leave
    nothing. ``exact`` wants the name to equal one of the ids.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    name = F.col("JobName")
    if match == "exact":
        return name.isin(run_ids)
    conditions = [name.rlike(i) for i in run_ids]
    if match == "all":
        return reduce(Column.__and__, conditions, F.lit(True))
    return reduce(Column.__or__, conditions, F.lit(False))


def filter_runs(df: DataFrame, run_ids: list[str], match: str = "all") -> DataFrame:
    """Rows of the runs, see :func:`run_condition`."""
    return df.where(run_condition(run_ids, match))


def rows_of_runs(jobs: DataFrame, run_ids: list[str] | DataFrame, match: str = "all") -> DataFrame:
    """All rows of the jobs that may belong to the runs: what to collapse for a report on them.

    ``jobs`` has ``JobRoot`` and is not collapsed yet. A job's name is the first of
    run-id length among its rows, so a job is a candidate if any such name matches; which of
    several names is the first is for the filter after the collapse.
    """
    named = jobs.where(F.length("JobName") == RUN_ID_LENGTH).select("JobRoot", "JobName")
    if isinstance(run_ids, DataFrame):
        named = filter_runs_in(named, run_ids)
    else:
        named = filter_runs(named, run_ids, match)
    root = named.select(F.col("JobRoot").alias("_root")).distinct()
    return jobs.join(root, F.col("JobRoot").eqNullSafe(F.col("_root")), "left_semi")


def filter_runs_in(df: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Rows whose ``JobName`` equals a ``run_id`` of the table ``run_ids``, as a semi-join."""
    wanted = run_ids.select(F.col("run_id").alias("JobName")).distinct()
    return df.join(wanted, "JobName", "left_semi")


def rows_of_rule(df: DataFrame, rule: str) -> DataFrame:
    return df.where(F.col("rule_name") == rule)


def distinct_rules(df: DataFrame) -> DataFrame:
    """Rule names present, without null, last name first."""
    named = df.select("rule_name").where(F.col("rule_name").isNotNull())
    return named.distinct().orderBy(F.col("rule_name").desc())


def _alloc_place(df: DataFrame) -> Column:
    root = F.col("JobRoot")
    return F.struct(root.try_cast("bigint"), root) if "JobRoot" in df.columns else F.lit(0)


def _alloc_spread(df: DataFrame, metrics: list[str]) -> list[str]:
    return ["JobRoot"] if "JobRoot" in df.columns else metrics


def _largest(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return numbers.max_skipping_nan(c) if floating else F.max(c)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def rule_quartiles(df: DataFrame, metrics: list[str], names: list[str] | None = None) -> DataFrame:
    """``rule_name`` and ``<metric>_<quartile>`` for ``names`` of ``QUARTILES``, exact, a row per rule."""
    wanted = [Quantile(f"{m}_{q}", m, QUARTILES[q]) for m in metrics for q in names or QUARTILES]
    return exact_quantiles(df, ["rule_name"], wanted, _alloc_spread(df, metrics))


def _with_quartiles(groups: DataFrame, quartiles: DataFrame) -> DataFrame:
    right = quartiles.withColumnRenamed("rule_name", "_rule")
    return groups.join(right, F.col("rule_name").eqNullSafe(F.col("_rule")), "left").drop("_rule")


def aggregate_per_rule(df: DataFrame, input_sizes: bool = False, quartiles: DataFrame | None = None) -> DataFrame:
    """Mean, median, sample deviation, min and max of each metric per rule.

    ``quartiles`` are those of :func:`rule_quartiles`, if they are known already;
    else the medians are found by reading ``df`` some times more: hand it a
    stored table. All passes shuffle partial rows, whatever a rule's size.
    """
    metrics = EFFICIENCY_METRICS + (SIZE_METRICS if input_sizes else [])
    firsts = ["QOS", "Account", "NodeList"]
    place = _alloc_place(df)
    quartiles = rule_quartiles(df, metrics, ["median"]) if quartiles is None else quartiles
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": lambda m: _largest(df, m)}
    groups = df.groupBy("rule_name").agg(
        *[of(m).alias(f"{m}_{name}") for m in metrics for name, of in moments.items()],
        F.min("Elapsed").alias("Elapsed_min"),
        F.max("Elapsed").alias("Elapsed_max"),
        *[first_non_null(F.col(c), place).alias(c) for c in firsts],
    )

    def statistics(m: str) -> list[str]:
        return [f"{m}_{name}" for name in ("mean", "median", "std", "min", "max")]

    return _with_quartiles(groups, quartiles).select(
        "rule_name", *[c for m in EFFICIENCY_METRICS for c in statistics(m)], "Elapsed_min", "Elapsed_max", *firsts,
        *[c for m in SIZE_METRICS if input_sizes for c in statistics(m)],
    )


def rule_distributions(df: DataFrame, metrics: list[str], quartiles: DataFrame | None = None) -> DataFrame:
    """What box plots of ``metrics`` show: a row per metric and rule.

    Quartiles interpolate linearly; fences lie 1.5 and 3 quartile ranges out.
    ``quartiles`` as in :func:`aggregate_per_rule`.
    """
    named = df.where(F.col("rule_name").isNotNull())
    quartiles = rule_quartiles(named, metrics) if quartiles is None else quartiles
    groups = named.groupBy("rule_name").agg(
        *[F.count(m).alias(f"{m}_n_values") for m in metrics],
        *[F.min(m).cast("double").alias(f"{m}_min_value") for m in metrics],
        *[_largest(df, m).cast("double").alias(f"{m}_max_value") for m in metrics],
    )
    wide = _with_quartiles(groups, quartiles)
    parts = ["n_values", "min_value", *QUARTILES, "max_value"]
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{p}").alias(p) for p in parts])
            for m in metrics
        ]
    )
    q1, q3 = F.col("q1"), F.col("q3")
    return wide.select("rule_name", F.inline(rows)).select(
        "metric",
        "rule_name",
        *parts,
        (q1 - 1.5 * (q3 - q1)).alias("lower_fence"),
        (q3 + 1.5 * (q3 - q1)).alias("upper_fence"),
        (q1 - 3.0 * (q3 - q1)).alias("far_lower_fence"),
        (q3 + 3.0 * (q3 - q1)).alias("far_upper_fence"),
    )


def rule_distribution(df: DataFrame, metric: str) -> DataFrame:
    return rule_distributions(df, [metric]).drop("metric")


def rule_outliers(df: DataFrame, distribution: DataFrame, metric: str) -> DataFrame:
    """Rows beyond the fences of their rule; ``suspected`` marks the far ones."""
    v = F.col(metric).cast("double")
    named = df.where(F.col("rule_name").isNotNull())
    fences = distribution.select(
        "rule_name", "lower_fence", "upper_fence", "far_lower_fence", "far_upper_fence"
    )
    with_fences = attach_group_rows(
        named, fences, ["rule_name"], _alloc_spread(df, [metric])
    )
    suspected = (v < F.col("far_lower_fence")) | (v > F.col("far_upper_fence"))
    return (
        with_fences.where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
        .withColumn("suspected", suspected)
        .drop("lower_fence", "upper_fence", "far_lower_fence", "far_upper_fence")
    )
