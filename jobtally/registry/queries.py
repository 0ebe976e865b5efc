"""The registered queries: every operator over the given tables.

Dates leave as text, doubles rounded to six places where their sums depend on
the order of addition, and values that may be NaN or infinite as a label next
to a null, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numbers, text, times
from ..operators import columns, daily, documents, inputs, logs, occupancy, period, rules, tables
from ..operators.allocations import aggregate_per_alloc
from ..operators.daily import METRICS
from ..operators.quantiles import Quantile, exact_quantiles
from ..plans.daily_report import daily_report
from ..plans.generic import generic_report
from ..plans.ingest import typed_rows
from ..plans import log_inputs
from ..plans.period_report import period_report_from_accounting
from ..plans.rule_report import displayed_table, labelled_table, run_allocations
from ..plans.run_days import collect_run_days, collect_run_days_of_texts
from ..schema import INTERESTING_COLUMNS, USEFUL_COLUMNS, column_subset, conform
from ..session import materialize
from ..sources.logs import lines_of_texts
from . import views
from .round_trips import ROUND_TRIPS
from .shown import day_text, finite_parts, r6, with_kinds

Query = Callable[[SparkSession, str], DataFrame]

RULE_INPUT = ["JobRoot", "rule_name", "MemEfficiencyPercent", "CPUEfficiencyPercent",
              "ElapsedRaw", "Elapsed", "QOS", "Account", "NodeList"]


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of_texts(views.log_texts(spark, sf))


def generic(spark: SparkSession, sf: str) -> DataFrame:
    return generic_report(views.accounting_rows(spark, sf))


def rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    allocations = columns.add_rule_columns(generic(spark, sf))
    return materialize(allocations.select(*RULE_INPUT))


def job_classification(spark: SparkSession, sf: str) -> DataFrame:
    jobs = columns.add_job_columns(views.accounting_rows(spark, sf))
    return jobs.select("JobID", "JobRoot", "JobInfoType")


def size_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes as dumps write them, decimals, missing units and texts without any size too."""
    orders = views.allocation_rows(spark, sf).select("JobID", F.col("ReqMem").alias("MaxRSS"))
    steps = views.step_rows(spark, sf).select("JobID", "MaxRSS")
    odd = views.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as JobID",
        "case o_custkey % 5 when 0 then '0' when 1 then '132.77M' when 2 then concat(o_custkey, 'T') "
        "when 3 then 'unknown' else concat(o_custkey, 'Gc') end as MaxRSS",
    )
    parsed = columns.parse_size(orders.unionByName(steps).unionByName(odd), "MaxRSS")
    return parsed.select("JobID", "MaxRSS", "MaxRSS_unit", "MaxRSS_G")


def cpu_time_parsing(spark: SparkSession, sf: str) -> DataFrame:
    parsed = columns.add_cpu_seconds(views.accounting_rows(spark, sf))
    return parsed.select("JobID", "TotalCPU", "TotalCPU_seconds")


def rule_columns(spark: SparkSession, sf: str) -> DataFrame:
    named = columns.add_rule_columns(views.allocation_rows(spark, sf))
    return named.select("JobID", "Comment", "rule_name", "wildcards")


def wait_and_duration(spark: SparkSession, sf: str) -> DataFrame:
    timed = columns.add_job_duration(columns.add_wait_time(views.allocation_rows(spark, sf)))
    return timed.select(
        "JobID", "wait_time_seconds", r6("wait_time_hours").alias("wait_time_hours"),
        "job_duration_seconds",
    )


def daily_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of every job on its own dump day, on the day after, and on one fixed day."""
    jobs = views.allocation_rows(spark, sf)
    same = columns.add_daily_duration(jobs, F.col("date"))
    after = columns.add_daily_duration(jobs, F.date_add("date", 1))
    fixed = columns.add_daily_duration(jobs, "1998-03-15")
    parts = [
        df.select("JobID", F.lit(which).alias("which"), day_text(),
                  r6("daily_duration_hours").alias("daily_duration_hours"))
        for which, df in (("same", same), ("after", after), ("fixed", fixed))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def daily_overlap_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = columns.explode_job_days(views.allocation_rows(spark, sf))
    return days.select("JobID", day_text(), r6("daily_duration_hours").alias("hours"))


def long_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Allocations that run up to 400 days longer."""
    jobs = columns.add_moments(views.allocation_rows(spark, sf))
    return jobs.withColumn("End_ts", F.expr("End_ts + make_dt_interval(cast(ElapsedRaw % 400 as int))"))


def daily_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs and CPU hours of every day by class, of jobs that run for up to a year."""
    days = occupancy.daily_occupancy(long_jobs(spark, sf), ["QOS"], F.col("AllocCPUS"))
    return days.select("QOS", day_text(), "running_jobs", r6("hours").alias("cpu_hours"))


def alloc_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    jobs = columns.add_job_columns(views.accounting_rows(spark, sf))
    collapsed = aggregate_per_alloc(jobs)
    return collapsed.select(
        "JobRoot", "JobID", "JobName", "JobInfoType", "Account", "QOS", "State", "Submit", "Start",
        "End", "Elapsed", "ElapsedRaw", "TotalCPU", "CPUTimeRAW", "AllocCPUS", "NodeList", "ReqMem",
        "MaxRSS", day_text(),
    )


def alloc_aggregate_by_day(spark: SparkSession, sf: str) -> DataFrame:
    jobs = columns.add_job_columns(views.accounting_rows(spark, sf))
    collapsed = aggregate_per_alloc(jobs, ["date", "JobRoot"])
    return collapsed.select(day_text(), "JobRoot", "JobID", "State", "ElapsedRaw", "NodeList")


def generic_report_query(spark: SparkSession, sf: str) -> DataFrame:
    report = generic(spark, sf).select(
        "JobRoot", "JobID", "JobName", "JobInfoType", "Account", "QOS", "State", "ElapsedRaw",
        "NodeList", "MaxRSS", "MaxRSS_unit", "MaxRSS_G", "ReqMem", "ReqMem_unit", "ReqMem_G",
        "MemEfficiencyRatio", "MemEfficiencyPercent", "TotalCPU_seconds", "CPUTimeRAW",
        "CPUEfficiencyPercent",
    )
    return with_kinds(report)


def memory_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    """Memory ratios over whatever sizes there are, zero and missing ones too."""
    sizes = views.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "case when l_partkey % 5 = 0 then 0 else cast(floor(l_extendedprice * 10) as bigint) end as MaxRSS",
        "case when l_suppkey % 7 = 0 then 0 when l_suppkey % 11 = 0 then null "
        "else cast(l_quantity as bigint) * 1024 end as ReqMem",
    )
    rated = columns.add_memory_efficiency(sizes)
    return rated.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *finite_parts("MemEfficiencyRatio"), *finite_parts("MemEfficiencyPercent"),
    )


def _runs(spark: SparkSession, sf: str, ids: list[str], match: str) -> DataFrame:
    picked = rules.filter_runs(generic(spark, sf), ids, match)
    return picked.select("JobRoot", "JobName", "QOS")


# md5 of '7' and '11' as run ids.
RUN_A = "8f14e45f-ceea-167a-5a36-dedd4bea2543"
RUN_B = "6512bd43-d9ca-a6e0-2c99-0b0a82652dca"


def run_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf, ["^8f14e", "dd4bea2543"], "all")


def run_filter_any(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs by their names and by patterns, from one pass over the report."""
    hows = {
        "set": rules.run_condition([RUN_A, RUN_B], "exact"),
        "pattern": rules.run_condition(["^8f14e", "^6512bd43"], "any"),
    }
    how = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in hows.items()]), lambda h: h.isNotNull())
    return generic(spark, sf).select("JobRoot", "JobName", "QOS", F.explode(how).alias("how"))


def run_filter_logged(spark: SparkSession, sf: str) -> DataFrame:
    ids = logs.run_ids_of_texts(views.log_texts(spark, sf)).select("run_id")
    picked = rules.filter_runs_in(generic(spark, sf), ids)
    return picked.select("JobRoot", "JobName", "QOS")


def rule_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    statistics = rules.aggregate_per_rule(rule_rows(spark, sf))
    return with_kinds(statistics).orderBy(F.col("rule_name").asc_nulls_first())


def rule_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The memory, CPU and runtime tables under their report labels, one row per cell."""
    statistics = materialize(rules.aggregate_per_rule(rule_rows(spark, sf)))
    cells = []
    for name in ("mem", "cpu", "runtime"):
        table = labelled_table(statistics, name)
        labels = [c for c in table.columns if c != "Nom de la règle"]
        values = F.map_from_arrays(
            F.array(*[F.lit(c) for c in labels]),
            F.array(*[F.col(f"`{c}`").cast("double") for c in labels]),
        )
        cells.append(
            table.select(F.col("Nom de la règle").alias("rule"), F.explode(values).alias("label", "value"))
        )
    return cells[0].unionByName(cells[1]).unionByName(cells[2]).select(
        "rule", "label", *finite_parts("value")
    )


def rule_display(spark: SparkSession, sf: str) -> DataFrame:
    statistics = rules.aggregate_per_rule(rule_rows(spark, sf))
    shown = displayed_table(labelled_table(statistics, "cpu"))
    names = [c for c in shown.columns if not c.endswith("_band")]
    return shown.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        *[F.col(f"`{c}_band`").alias(f"b{i}") for i, c in enumerate(names) if i],
    )


def rule_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return with_kinds(rules.rule_distributions(rule_rows(spark, sf), rules.EFFICIENCY_METRICS))


def rule_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = rule_rows(spark, sf)
    fences = rules.rule_distribution(rows, "CPUEfficiencyPercent")
    beyond = rules.rule_outliers(rows, fences, "CPUEfficiencyPercent")
    return beyond.select(
        "rule_name", "JobRoot", r6("CPUEfficiencyPercent").alias("value"), "suspected"
    )


def rule_names(spark: SparkSession, sf: str) -> DataFrame:
    return rules.distinct_rules(columns.add_rule_columns(generic(spark, sf)))


def one_rule(spark: SparkSession, sf: str) -> DataFrame:
    named = columns.add_rule_columns(generic(spark, sf))
    return rules.rows_of_rule(named, "align").select("JobRoot", "rule_name", "wildcards")


def _price_quantiles(spark: SparkSession, sf: str, **options: int) -> DataFrame:
    lines = materialize(views.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice"))
    wanted = [
        Quantile("q01", "l_extendedprice", 0.01),
        Quantile("q25", "l_extendedprice", 0.25),
        Quantile("median", "l_extendedprice", 0.5),
        Quantile("q99", "l_extendedprice", 0.99),
    ]
    result = exact_quantiles(lines, ["l_returnflag"], wanted, ["l_orderkey", "l_partkey"], **options)
    return result.select("l_returnflag", *[r6(q.name).alias(q.name) for q in wanted])


def exact_quantile_report(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of order-line prices per return flag: few groups, each a third of all rows."""
    return _price_quantiles(spark, sf)


def narrowed_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same by eight bits a pass and brackets of a hundred values, so that ranks take several passes."""
    return _price_quantiles(spark, sf, bits=8, most_values=100)


def input_size_join(spark: SparkSession, sf: str) -> DataFrame:
    enriched = inputs.enrich_with_input_sizes(generic(spark, sf), views.size_rows(spark, sf), True)
    return enriched.select(
        "JobRoot", "JobID", "input_size_bytes", "inputs", *finite_parts("MinPerMo"),
        *finite_parts("UsedRAMPerMo"), *finite_parts("MaxRSSPerMo"),
    )


def rule_report_relative(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics per rule with input sizes from the logs; sizes of 0 make them infinite or no number."""
    sizes = log_inputs.log_input_sizes_of_texts(views.log_texts(spark, sf), views.manifest(spark, sf))
    runs = run_allocations(views.accounting_rows(spark, sf), None, sizes)
    wanted = [*RULE_INPUT, "UsedRAMPerMo", "MinPerMo"]
    statistics = rules.aggregate_per_rule(materialize(runs.select(*wanted)), input_sizes=True)
    return with_kinds(statistics)


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_report(views.accounting_rows(spark, sf))


def daily_metrics_query(spark: SparkSession, sf: str) -> DataFrame:
    metrics = _daily(spark, sf)
    doubles = {"cpu_hours", "cpu_percent", "gb_seconds", "ram_percent", "wait_mean", "wait_median",
               "duration_mean", "duration_median"}
    return metrics.select(
        day_text(), "scope", "QOS", *[r6(m).alias(m) if m in doubles else F.col(m) for m in METRICS]
    )


def daily_display(spark: SparkSession, sf: str) -> DataFrame:
    shown = daily.displayed(_daily(spark, sf))
    labels = [c for c in shown.columns if c not in ("date", "scope", "QOS")]
    times_shown = [c for c in labels if "(secondes)" in c]
    numbers_shown = [c for c in labels if c not in times_shown]
    return shown.select(
        day_text(), "scope", "QOS",
        *[F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(numbers_shown)],
        *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(times_shown)],
    )


def daily_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Percentages against a capacity that differs by date, memory counted exactly."""
    capacity = (
        views.table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            (F.count("*") * 86400 * 4).alias("cpu_secondes"),
            (F.count("*") * 86400).alias("gb_secondes"),
        )
    )
    metrics = daily_report(views.accounting_rows(spark, sf), capacity, exact_gb=True)
    return metrics.select(
        day_text(), "scope", "QOS", r6("cpu_percent").alias("cpu_percent"),
        r6("ram_percent").alias("ram_percent"),
    )


def events_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily shape on the event stream's table: per day, and per day and type."""
    events = views.table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), "event_type", "user_id", "value"
    )
    exact = F.sum(F.col("value").cast("decimal(28,6)"))  # whatever the order of addition
    grouped = events.groupingSets([["date"], ["date", "event_type"]], "date", "event_type").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("value") >= 10).alias("n_large"),
        r6(exact.cast("double")).alias("total"),
        r6(exact.cast("double") / F.count("value")).alias("mean"),
        F.min("value").alias("smallest"),
        F.max("value").alias("largest"),
        F.max("user_id").alias("last_user"),
    )
    none = F.lit(None).cast("string")
    scopes = F.array(*[F.struct(F.lit(level).alias("level"), t.alias("event_type")) for level, t in ((0, F.col("event_type")), (1, none))])
    both = events.select("date", "user_id", "value", F.inline(scopes))
    medians = exact_quantiles(both, ["date", "level", "event_type"], [Quantile("median", "value", 0.5)], ["user_id", "value"])
    on = (grouped.level == medians.level) & grouped.date.eqNullSafe(medians.date)
    joined = grouped.join(medians, on & grouped.event_type.eqNullSafe(medians.event_type), "left")
    scope = F.when(grouped.level == 0, "type").otherwise("global").alias("scope")
    shown = [grouped[c] for c in grouped.columns if c not in ("date", "level")]
    return joined.select(grouped.date.cast("string").alias("date"), scope, *shown, r6(medians["median"]).alias("median"))


def _period(spark: SparkSession, sf: str):
    rows = views.accounting_rows(spark, sf)
    return period_report_from_accounting(rows, "1996-01-01", "1999-12-31", stored=True)


def period_series(spark: SparkSession, sf: str) -> DataFrame:
    return _period(spark, sf).series.select(day_text(), "metric", "title", r6("value").alias("value"))


def period_range(spark: SparkSession, sf: str) -> DataFrame:
    report = _period(spark, sf)
    rounded = report.ranges.select(
        "metric", r6("min_value").alias("min_value"), r6("max_value").alias("max_value")
    )
    days = report.num_days.select(
        F.lit("days").alias("metric"),
        F.col("num_days").cast("double").alias("min_value"),
        F.col("num_days").cast("double").alias("max_value"),
    )
    return rounded.unionByName(days)


def _shown_records(records: DataFrame) -> DataFrame:
    return records.select(
        "log_path", "record_no", "slurm_jobid", "job_id", "rule_name",
        F.array_join("inputs", ";").alias("inputs"), F.size("inputs").cast("bigint").alias("n_inputs"),
    )


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_records(logs.log_records_of_texts(views.log_texts(spark, sf)))


def log_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines as if each log had been read in pieces of four lines."""
    place = (F.floor(F.col("row") / 4).alias("block"), (F.col("row") % 4).alias("row"))
    return log_lines(spark, sf).select("log_path", *place, "line")


def log_records_by_line(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_records(logs.log_records(log_blocks(spark, sf)))


def log_record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every record, numbered as for logs that several tasks read."""
    parts = logs.record_parts(
        log_blocks(spark, sf), F.count("*").alias("n_lines"),
        F.min_by("line", "row").alias("first_line"), F.max_by("line", "row").alias("last_line"),
    )
    return parts.groupBy("log_path", "start_block", "record_no").agg(
        F.sum("n_lines").alias("n_lines"),
        F.min_by("first_line", "block").alias("first_line"),
        F.max_by("last_line", "block").alias("last_line"),
    ).drop("start_block")


def log_run_ids(spark: SparkSession, sf: str) -> DataFrame:
    return logs.run_ids(log_lines(spark, sf))


def log_dates(spark: SparkSession, sf: str) -> DataFrame:
    return logs.run_dates(log_lines(spark, sf)).select(day_text())


def project_paths(spark: SparkSession, sf: str) -> DataFrame:
    return views.log_texts(spark, sf).select(
        "log_path", text.project_dir(F.col("log_path")).alias("project_dir")
    )


def log_input_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return log_inputs.log_input_sizes_of_texts(views.log_texts(spark, sf), views.manifest(spark, sf))


def run_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = collect_run_days_of_texts(views.allocation_rows(spark, sf), views.log_texts(spark, sf))
    return rows.select("JobID", day_text())


def run_days_by_line(spark: SparkSession, sf: str) -> DataFrame:
    rows = collect_run_days(views.allocation_rows(spark, sf), log_lines(spark, sf))
    return rows.select("JobID", day_text())


def merge_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.allocation_rows(spark, sf)
    late = F.col("date") >= F.lit("1998-01-01").cast("date")
    early_part = rows.where(~late).select("JobID", "QOS", F.col("ElapsedRaw").cast("string").alias("ElapsedRaw"))
    late_part = rows.where(late).select("State", "JobID", "ElapsedRaw")
    return tables.union_by_name([early_part, late_part]).select("JobID", "QOS", "State", "ElapsedRaw")


def malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = views.dump_lines(spark, sf)
    kept = tables.drop_malformed_lines(lines, 8)
    counts = tables.count_malformed_lines(lines, 8)
    return kept.select(F.lit("kept").alias("what"), "line").unionByName(
        counts.select(F.lit("removed").alias("what"), F.col("removed_lines").cast("string").alias("line"))
    )


def typed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed_rows(views.accounting_lines(spark, sf))
    return rows.select(
        "JobID", "JobName", "Account", "QOS", "Submit", "ElapsedRaw", "NTasks", "WorkDir",
        "AllocCPUS", "Comment", "MaxRSS",
    )


def efficiency_bands(spark: SparkSession, sf: str) -> DataFrame:
    rated = generic(spark, sf).select(
        "JobRoot",
        F.col("MemEfficiencyPercent").alias("Efficacité mémoire moyenne"),
        F.col("CPUEfficiencyPercent").alias("Efficacité CPU moyenne"),
        (F.col("ElapsedRaw") % 160).alias("Durée moyenne"),
        F.col("ElapsedRaw").alias("Autre"),
    )
    banded = columns.add_bands(rated)
    return banded.select(
        "JobRoot",
        F.col("`Efficacité mémoire moyenne_band`").alias("mem_band"),
        F.col("`Efficacité CPU moyenne_band`").alias("cpu_band"),
        F.col("`Durée moyenne_band`").alias("duration_band"),
        numbers.efficiency_band(F.col("Autre"), "Autre").alias("other_band"),
    )


def duration_labels(spark: SparkSession, sf: str) -> DataFrame:
    jobs = columns.add_job_duration(views.allocation_rows(spark, sf))
    share = F.col("ElapsedRaw") / F.lit(7.0)
    return jobs.select(
        "JobID",
        times.format_duration(F.col("job_duration_seconds")).alias("duration"),
        times.format_duration(F.col("ElapsedRaw").cast("string")).alias("elapsed"),
        times.format_duration(F.col("Elapsed")).alias("not_a_number"),
        times.format_duration(share - 100).alias("share"),
        numbers.round_half_away(share, 2).alias("two_places"),
        numbers.round_half_away(share, 3).alias("three_places"),
    )


def columnar_json(spark: SparkSession, sf: str) -> DataFrame:
    """Runtimes per rule as one columnar document."""
    per_rule = rule_rows(spark, sf).groupBy("rule_name").agg(
        F.count("*").alias("jobs"),
        F.min("ElapsedRaw").alias("shortest"),
        F.max("ElapsedRaw").alias("longest"),
        F.min("Account").alias("account"),
        F.min(F.when(F.col("rule_name") != "sort", F.col("NodeList"))).alias("node"),
    )
    return documents.columnar_json(per_rule, ["rule_name"])


def daily_document(spark: SparkSession, sf: str) -> DataFrame:
    """The daily documents, read back entry by entry."""
    written = documents.daily_documents(_daily(spark, sf))
    whole = F.from_json("document", "map<string,map<string,double>>")
    entries = written.select("date", F.explode(whole).alias("key", "fields"))
    values = entries.select("date", "key", F.explode("fields").alias("label", "value"))
    return values.select(day_text(), "key", "label", r6("value").alias("value"))


def document_days(spark: SparkSession, sf: str) -> DataFrame:
    """The overall entries that the period report takes from the documents."""
    days = documents.document_metrics(documents.daily_documents(_daily(spark, sf)))
    series = period.metric_series(period.in_period(days, "1997-01-01", "1997-12-31"))
    return series.select(day_text(), "metric", r6("value").alias("value"))


def column_subsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = conform(views.accounting_rows(spark, sf))
    useful = column_subset(rows, USEFUL_COLUMNS)
    common = column_subset(useful, INTERESTING_COLUMNS)
    return common.select("Account", "AllocCPUS", "Comment", "ElapsedRaw", "JobID", "JobName",
                         "MaxRSS", "QOS", "ReqMem", "Submit", "TotalCPU", "User", "WorkDir")


QUERIES: dict[str, Query] = {
    "job_classification": job_classification,
    "size_parsing": size_parsing,
    "cpu_time_parsing": cpu_time_parsing,
    "rule_columns": rule_columns,
    "wait_and_duration": wait_and_duration,
    "daily_overlap": daily_overlap,
    "daily_overlap_calendar": daily_overlap_calendar,
    "daily_occupancy": daily_occupancy,
    "alloc_aggregate": alloc_aggregate,
    "alloc_aggregate_by_day": alloc_aggregate_by_day,
    "generic_report": generic_report_query,
    "memory_efficiency": memory_efficiency,
    "run_filter_all": run_filter_all,
    "run_filter_any": run_filter_any,
    "run_filter_logged": run_filter_logged,
    "rule_aggregate": rule_aggregate,
    "rule_tables": rule_tables,
    "rule_display": rule_display,
    "rule_distribution": rule_distribution,
    "rule_outliers": rule_outliers,
    "rule_names": rule_names,
    "one_rule": one_rule,
    "exact_quantiles": exact_quantile_report,
    "narrowed_quantiles": narrowed_quantiles,
    "input_size_join": input_size_join,
    "rule_report_relative": rule_report_relative,
    "daily_metrics": daily_metrics_query,
    "daily_display": daily_display,
    "daily_capacity": daily_capacity,
    "events_daily": events_daily,
    "period_series": period_series,
    "period_range": period_range,
    "log_records": log_records,
    "log_records_by_line": log_records_by_line,
    "log_record_lines": log_record_lines,
    "log_run_ids": log_run_ids,
    "log_dates": log_dates,
    "project_paths": project_paths,
    "log_input_sizes": log_input_sizes,
    "run_days": run_days,
    "run_days_by_line": run_days_by_line,
    "merge_days": merge_days,
    "malformed_lines": malformed_lines,
    "typed_ingest": typed_ingest,
    "efficiency_bands": efficiency_bands,
    "duration_labels": duration_labels,
    "columnar_json": columnar_json,
    "daily_document": daily_document,
    "document_days": document_days,
    "column_subsets": column_subsets,
    **ROUND_TRIPS,
}
