"""Queries that write the shaped tables with the public writers and read them back with the public readers.

Each goes to a folder of its own in the shared folder, removed when the Python process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import logs, period
from ..operators.allocations import aggregate_per_alloc
from ..plans import log_inputs
from ..plans.daily_report import daily_report
from ..plans.ingest import dated_rows, ingest
from ..plans.rule_report import RULE_LABEL, TABLE_LABELS, rule_report, run_allocations
from ..session import checkpoint_folder
from ..sources.accounting import read_accounting_csv, scan_day, scan_day_files, scan_parquet, scan_table, scan_table_day
from ..sources.clustered import ClusteredTable, scan_clustered_table, write_clustered_table
from ..sources.logs import read_log_pieces
from ..sources.reports import scan_daily_json
from ..sources.sinks import (
    write_accounting_table, write_daily_json, write_day_files, write_input_sizes, write_merged_parquet,
)
from ..sources.sizes import read_input_sizes, scan_file_sizes
from . import views
from .shown import day_text, finite_parts, r6, with_kinds



def folder(spark: SparkSession) -> str:
    path = f"{checkpoint_folder(spark).rstrip('/')}/round-trip-{uuid.uuid4()}"

    def remove() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone, and its folder with it
            pass

    atexit.register(remove)
    return path


def all_days(rows: DataFrame) -> list[str]:
    """The days of ``rows``, the last one last."""
    return [str(r["date"]) for r in rows.select("date").distinct().orderBy("date").collect()]


def ingested_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "JobID", "JobName", "Account", "QOS", "Submit", "ElapsedRaw", "NTasks", "WorkDir", "AllocCPUS", "Comment", "MaxRSS",
    )


def csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """S1: typed rows as a dump with a header line, read as such."""
    lines = views.accounting_lines(spark, sf).withColumn("file_name", F.lit("dump-2026-01-15"))
    path = folder(spark)
    dated_rows(lines).drop("date").write.options(sep="|", header=True, quote="", nullValue="", emptyValue="").csv(path)
    return ingested_columns(read_accounting_csv(spark, path))


def ingested_table(spark: SparkSession, sf: str) -> DataFrame:
    """C6, S3: dump files ingested into the accounting table, and scanned from it."""
    dumps, table = folder(spark), folder(spark)
    views.accounting_lines(spark, sf).write.text(dumps)
    removed = ingest(spark, f"{dumps}/*.txt", table, day="2026-01-15")
    rows = ingested_columns(scan_table(spark, table)).select("JobID", "Submit", "ElapsedRaw", "WorkDir")
    return rows.withColumn("removed_lines", F.lit(removed))


def one_table_day(spark: SparkSession, sf: str) -> DataFrame:
    """S4: one day of the table partitioned by date."""
    table, rows = folder(spark), views.allocation_rows(spark, sf)
    write_accounting_table(rows, table)
    return scan_table_day(spark, table, all_days(rows)[-1]).select("JobID", "QOS", "ElapsedRaw", day_text())


def day_files(spark: SparkSession, sf: str) -> DataFrame:
    """S4, S5, K1: a loose file for every day; all of them read, and one."""
    path, rows = folder(spark), views.allocation_rows(spark, sf)
    write_day_files(rows, path)
    days = all_days(rows)
    several = scan_day_files(spark, path, [*days, "2031-01-01"]).withColumn("how", F.lit("several"))
    one = scan_day(spark, path, days[0]).withColumn("how", F.lit("one"))
    return several.unionByName(one).select("how", "JobID", "QOS", "ElapsedRaw", day_text())


def clustered(spark: SparkSession, sf: str) -> ClusteredTable:
    """All rows clustered on the job; jobs of eight rows and those without steps make both parts."""
    name = f"jobtally_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_clustered_table(views.accounting_rows(spark, sf), name, folder(spark), buckets, most_rows=7)
    return scan_clustered_table(spark, name)


def clustered_allocations(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on a table clustered on the job."""
    collapsed = clustered(spark, sf).per_job(aggregate_per_alloc)
    return collapsed.select(
        "JobRoot", "JobID", "JobName", "JobInfoType", "Account", "QOS", "State", "Submit", "Start", "End", "Elapsed",
        "ElapsedRaw", "TotalCPU", "CPUTimeRAW", "AllocCPUS", "NodeList", "ReqMem", "MaxRSS", day_text(),
    )


def clustered_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4 from the clustered table: allocations by date and job without a shuffle, then one on the date."""
    metrics = daily_report(clustered(spark, sf))
    return metrics.select(
        day_text(), "scope", "QOS", "cpu_seconds", "submitted", "ended", "failed", "duration_max",
        r6("wait_median").alias("wait_median"), r6("ram_percent").alias("ram_percent"),
    )


def merged_file(spark: SparkSession, sf: str) -> DataFrame:
    """K2: frames of different columns and types in one file."""
    rows = views.allocation_rows(spark, sf)
    late = F.col("date") >= F.lit("1998-01-01").cast("date")
    early_part = rows.where(~late).select("JobID", "QOS", F.col("ElapsedRaw").cast("string").alias("ElapsedRaw"))
    path = folder(spark)
    write_merged_parquet([early_part, rows.where(late).select("State", "JobID", "ElapsedRaw")], path)
    return scan_parquet(spark, path).select("JobID", "QOS", "State", "ElapsedRaw")


def input_size_file(spark: SparkSession, sf: str) -> DataFrame:
    """K3, S9: the input-size table written and read."""
    path = folder(spark)
    write_input_sizes(log_inputs.log_input_sizes_of_texts(views.log_texts(spark, sf), views.manifest(spark, sf)), path)
    return read_input_sizes(spark, path).select(
        F.col("slurm_jobid").cast("string").alias("slurm_jobid"), F.col("job_id").cast("string").alias("job_id"),
        "rule_name", "input_size_bytes", "inputs",
    )


def file_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """S8: a file of customer names for each nation, found and measured."""
    path = folder(spark)
    names = views.table(spark, sf, "customer").select("c_nationkey", "c_name")
    names.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = scan_file_sizes(spark, path).where("path like '%.txt'")
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("bigint")
    return found.groupBy(nation.alias("nation")).agg(F.sum("length").alias("length"), F.count("*").alias("files"))


def daily_json_files(spark: SparkSession, sf: str) -> DataFrame:
    """K4, S10: daily documents written, and those of a year read back."""
    path = folder(spark)
    write_daily_json(daily_report(views.accounting_rows(spark, sf)), path)
    series = period.metric_series(scan_daily_json(spark, path, "1997-01-01", "1997-12-31"))
    return series.select(day_text(), "metric", r6("value").alias("value"))


def _full_report(spark: SparkSession, sf: str):
    sizes = log_inputs.log_input_sizes_of_texts(views.log_texts(spark, sf), views.manifest(spark, sf))
    return rule_report(views.accounting_rows(spark, sf), None, sizes, output=folder(spark))


def rule_report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """C2: all five tables of the report with sizes under their labels, one row a cell."""
    cells = None
    for name, table in _full_report(spark, sf).tables.items():
        labels = TABLE_LABELS[name][1:]
        values = F.map_from_arrays(
            F.array(*[F.lit(c) for c in labels]), F.array(*[F.col(f"`{c}`").cast("double") for c in labels])
        )
        part = table.select(F.col(f"`{RULE_LABEL}`").alias("rule"), F.explode(values).alias("label", "value"))
        cells = part if cells is None else cells.unionByName(part)
    return cells.select("rule", "label", *finite_parts("value"))


def rule_report_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """C2, A11: the distributions of all five metrics."""
    return with_kinds(_full_report(spark, sf).distributions)


def enriched_allocations(spark: SparkSession, sf: str) -> DataFrame:
    """K5: the allocations that the report writes."""
    return _full_report(spark, sf).allocations.select(
        "JobRoot", "rule_name", "input_size_bytes", "inputs", *finite_parts("MinPerMo"), *finite_parts("UsedRAMPerMo")
    )


def rule_report_run(spark: SparkSession, sf: str) -> DataFrame:
    """C2, F1: allocations of one run, other jobs left out before the collapse."""
    picked = run_allocations(views.accounting_rows(spark, sf), ["^8f14e", "dd4bea2543"])
    return picked.select("JobRoot", "JobName", "QOS", "rule_name", "ElapsedRaw", "NodeList")


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """One log file for each of 40 crews of customers, the logs of their orders on end."""
    path = folder(spark)
    key = F.regexp_extract("log_path", r"(\d+)\.log$", 1).cast("bigint")
    texts = views.log_texts(spark, sf).select(
        (key % 40).alias("crew"), key.alias("key"), F.rtrim("content", F.lit("\n")).alias("value")
    )
    crews = texts.repartition("crew").sortWithinPartitions("crew", "key").select("crew", "value")
    crews.write.partitionBy("crew").text(path)
    return read_log_pieces(spark, [f"{path}/crew=*/*.txt"])


def log_record_files(spark: SparkSession, sf: str) -> DataFrame:
    """S6, P19: records of written log files, by the reader that splits at records."""
    records = logs.log_records_of_pieces(log_files(spark, sf))
    return records.select(
        F.regexp_extract("log_path", r"crew=(\d+)", 1).alias("crew"), "record_no", "slurm_jobid", "job_id", "rule_name",
        F.array_join("inputs", ";").alias("inputs"), F.size("inputs").cast("bigint").alias("n_inputs"),
    )


ROUND_TRIPS = {
    "log_record_files": log_record_files,
    "csv_file": csv_file,
    "ingested_table": ingested_table,
    "one_table_day": one_table_day,
    "day_files": day_files,
    "clustered_allocations": clustered_allocations,
    "clustered_daily": clustered_daily,
    "merged_file": merged_file,
    "input_size_file": input_size_file,
    "file_sizes": file_sizes,
    "daily_json_files": daily_json_files,
    "rule_report_tables": rule_report_tables,
    "rule_report_distributions": rule_report_distributions,
    "enriched_allocations": enriched_allocations,
    "rule_report_run": rule_report_run,
}
