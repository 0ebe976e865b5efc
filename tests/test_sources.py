"""Dumps, Parquet tables and documents written and read back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtally.operators.daily import METRIC_LABELS
from jobtally.operators.tables import rows_of_dates
from jobtally.plans.daily_report import daily_report, daily_report_of_day
from jobtally.plans.generic import generic_report
from jobtally.plans.ingest import dated_rows, ingest
from jobtally.plans.period_report import period_report_from_json, period_report_from_metrics
from jobtally.plans.rule_report import rule_report
from jobtally.plans.run_days import collect_run_day_files, collect_run_days
from jobtally.schema import (
    ACCOUNTING_COLUMNS, ACCOUNTING_SCHEMA, INTERESTING_COLUMNS, USEFUL_COLUMNS, column_subset, conform,
)
from jobtally.sources import accounting, reports, sinks
from jobtally.sources.accounting import scan_table
from jobtally.sources.logs import lines_of_texts, read_log_lines
from jobtally.streaming.ingest import start_ingest

RUN = "59b3d4de-2b08-4a7c-a78d-3f2c8560439c"
HEADER = "|".join(ACCOUNTING_COLUMNS)


def dump_line(**fields):
    return "|".join(str(fields.get(c, "")) for c in ACCOUNTING_COLUMNS)


def sample_lines(day="2026-01-15", job=33979):
    times = dict(Submit=f"{day}T19:33:36", Start=f"{day}T19:33:36", End=f"{day}T19:46:34")
    return [
        dump_line(JobID=job, JobName=RUN, Comment="rule_vidjil_wildcards__data_analysis", ReqMem="1000M",
                  TotalCPU="12:53.010", CPUTimeRAW=778, ElapsedRaw=778, Elapsed="00:12:58", State="COMPLETED",
                  QOS="routine", Account="routine", **times),
        dump_line(JobID=f"{job}.batch", JobName="batch", MaxRSS="108200K", TotalCPU="00:01.983", CPUTimeRAW=778,
                  ElapsedRaw=778, State="COMPLETED", Account="routine", **times),
        dump_line(JobID=f"{job}.0", JobName='"python|'.replace("|", ""), MaxRSS="1043168K", TotalCPU="12:51.026",
                  CPUTimeRAW=775, ElapsedRaw=775, State="COMPLETED", Account="routine"),
    ]


def write_dump(path, lines, end="\n"):
    path.write_bytes((end.join([HEADER, *lines]) + end).encode())
    return str(path)


def test_schema_shape():
    assert len(ACCOUNTING_SCHEMA) == 109 and len(USEFUL_COLUMNS) == 61 and len(INTERESTING_COLUMNS) == 33
    assert len({c.lower() for c in ACCOUNTING_COLUMNS}) == 109
    assert set(INTERESTING_COLUMNS) <= set(USEFUL_COLUMNS) <= set(ACCOUNTING_COLUMNS)


def check_sample_report(report):
    row = report.first()
    assert (row.JobRoot, row.JobID, row.JobName, row.JobInfoType) == ("33979", "33979", RUN, "allocation")
    assert (row.MaxRSS, row.ReqMem) == (1068204032, 1048576000)
    assert row.MemEfficiencyPercent == pytest.approx(101.871875)
    assert row.TotalCPU_seconds == 773
    assert row.CPUEfficiencyPercent == pytest.approx(773 / 778 * 100)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_read_accounting_csv(spark, tmp_path, end):
    df = accounting.read_accounting_csv(spark, write_dump(tmp_path / "d.csv", sample_lines(), end))
    assert df.where("WorkDir is not null").count() == 0
    assert df.schema == ACCOUNTING_SCHEMA or [f.name for f in df.schema] == ACCOUNTING_COLUMNS
    assert df.where(F.col("JobID").endswith(".0")).first().JobName == '"python'
    check_sample_report(generic_report(df))
    bad = sample_lines() + [dump_line(JobID="1", AllocCPUS="many")]
    with pytest.raises(Exception):
        accounting.read_accounting_csv(spark, write_dump(tmp_path / "bad.csv", bad)).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ingest_and_daily_report(spark, tmp_path, end):
    lines = sample_lines()
    lines.insert(1, "too|few|fields")
    lines.append(dump_line(JobID="9") + "|extra")
    dump = write_dump(tmp_path / "2026-01-15.csv", lines, end)
    other = write_dump(tmp_path / "2026-01-16.csv", sample_lines("2026-01-16", 40000), end)
    table = str(tmp_path / "table")
    assert ingest(spark, [dump, other], table) == 2
    rows = accounting.scan_table(spark, table)
    assert rows.count() == 6 and set(ACCOUNTING_COLUMNS) <= set(rows.columns)
    day = accounting.scan_table_day(spark, table, "2026-01-15")
    assert day.count() == 3
    check_sample_report(generic_report(day))
    with pytest.raises(FileNotFoundError):
        accounting.scan_table_day(spark, table, "2026-02-01")
    daily = {(str(r.date), r.scope, r.QOS): r for r in daily_report(rows).collect()}
    assert len(daily) == 4
    metrics = daily["2026-01-15", "global", None]
    assert metrics.cpu_seconds == 773 and metrics.ram_percent == 0.0
    assert metrics.gb_seconds == pytest.approx(773.9874877929688)
    assert (metrics.submitted, metrics.started, metrics.ended, metrics.succeeded) == (1, 1, 1, 1)


def test_days_written_again(spark, tmp_path):
    table = str(tmp_path / "table")
    first = write_dump(tmp_path / "2026-01-15.csv", sample_lines())
    second = write_dump(tmp_path / "2026-01-16.csv", sample_lines("2026-01-16", 40000))
    assert ingest(spark, [first, second], table) == 0
    assert ingest(spark, [first], table, replace_days=True, recount=True) == 0
    assert spark.read.parquet(table).count() == 6
    ingest(spark, [first], table)
    assert spark.read.parquet(table).groupBy("date").count().orderBy("date").first()["count"] == 6
    ingest(spark, [second], table, day="2026-01-17")
    assert spark.read.parquet(table).where("date = '2026-01-17'").count() == 3
    with pytest.raises(Exception, match="no date for dump"):
        ingest(spark, [write_dump(tmp_path / "undated.csv", sample_lines())], table)


def test_bad_integers(spark, tmp_path):
    dump = write_dump(tmp_path / "2026-01-15.csv", sample_lines() + [dump_line(JobID="1", AllocCPUS="many")])
    lines = accounting.read_dump_lines(spark, dump)
    with pytest.raises(Exception):
        dated_rows(lines).collect()
    kept = dated_rows(lines, reject=True)
    assert kept.count() == 4 and kept.where("JobID = '1'").first().AllocCPUS is None
    assert accounting.rejected_lines(lines).count() == 1


def test_day_files(spark, tmp_path):
    rows = dated_rows(accounting.read_dump_lines(spark, write_dump(tmp_path / "2026-01-15.csv", sample_lines())))
    folder = tmp_path / "db"
    sinks.write_parquet(rows.select(*ACCOUNTING_COLUMNS), str(folder / "2026-01-15.parquet"))
    sinks.write_parquet(rows.select("JobID", "QOS", "ElapsedRaw"), str(folder / "2026-01-16.parquet"))
    both = accounting.scan_day_files(spark, str(folder), ["2026-01-16", "2026-01-15", "2026-01-20"])
    assert both.groupBy("date").count().count() == 2 and both.count() == 6
    assert both.where("date = '2026-01-16'").where("State is not null").count() == 0
    check_sample_report(generic_report(accounting.scan_day(spark, str(folder), "2026-01-15")))
    with pytest.raises(FileNotFoundError):
        accounting.scan_day(spark, str(folder), "2026-01-20")
    text = "[Thu Jan 15 10:00:00 2026]\n[Fri Jan 30 10:00:00 2026]\n"
    lines = lines_of_texts(spark.createDataFrame([("/l", text)], "log_path string, content string"))
    assert collect_run_day_files(spark, str(folder), lines).count() == 3
    none = lines_of_texts(spark.createDataFrame([("/l", "[x]")], "log_path string, content string"))
    with pytest.raises(FileNotFoundError):
        collect_run_day_files(spark, str(folder), none)


def test_daily_documents_round_trip(spark, tmp_path):
    rows = dated_rows(accounting.read_dump_lines(spark, write_dump(tmp_path / "2026-01-15.csv", sample_lines())))
    folder = tmp_path / "db"
    sinks.write_parquet(rows.select(*ACCOUNTING_COLUMNS), str(folder / "2026-01-15.parquet"))
    out = str(tmp_path / "json")
    metrics = daily_report_of_day(spark, str(folder), "2026-01-15", out)
    later = metrics.withColumn("date", F.lit("2026-01-17").cast("date")).withColumn("cpu_percent", F.lit(50.0))
    sinks.write_daily_json(later, out)
    sinks.write_daily_json(later, out)
    (tmp_path / "json" / "2026-01-18.json").write_text('{\n "global": {}\n}')
    from_json = period_report_from_json(spark, out, "2026-01-01", "2026-01-31")
    values = {(str(r.date), r.metric): r.value for r in from_json.series.collect()}
    cpu = "Pourcentage d'utilisation CPU"
    assert values["2026-01-15", cpu] == pytest.approx(773 / 36633600 * 100)
    assert values["2026-01-17", cpu] == 50.0 and values["2026-01-18", cpu] == 0.0
    assert from_json.num_days.first().num_days == 2
    direct = period_report_from_metrics(metrics.unionByName(later), "2026-01-01", "2026-01-31")
    assert {(str(r.date), r.metric): r.value for r in direct.series.collect()}.items() <= values.items()
    with pytest.raises(LookupError):
        reports.scan_daily_json(spark, out, "2025-01-01", "2025-12-31")
    sinks.write_daily_rows(metrics, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2


def test_daily_documents_are_written_by_many_tasks(spark, tmp_path):
    day = F.expr("date_add(date'2026-01-01', cast(id as int))").alias("date")
    values = [F.col("id").cast("double").alias(c) for c in METRIC_LABELS]
    metrics = spark.range(0, 40, 1, 2).select(day, F.lit("global").alias("scope"), F.lit(None).cast("string").alias("QOS"), *values)
    sinks.write_daily_json(metrics, str(tmp_path))
    files = list(tmp_path.glob("date=*/part-*.txt"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 4
    days = reports.scan_daily_json(spark, str(tmp_path), "2026-01-01", "2026-12-31").collect()
    assert {(r.date - dt.date(2026, 1, 1)).days: r.metrics["CPU.Secondes"] for r in days} == {i: i for i in range(40)}


def test_merged_and_enriched_outputs(spark, tmp_path):
    rows = dated_rows(accounting.read_dump_lines(spark, write_dump(tmp_path / "2026-01-15.csv", sample_lines())))
    sinks.write_merged_parquet([rows.select("JobID", "QOS"), rows.select("JobID", "State")], str(tmp_path / "m"))
    merged = accounting.scan_parquet(spark, str(tmp_path / "m"))
    assert merged.count() == 6 and merged.columns == ["JobID", "QOS", "State"]
    report = rule_report(rows, [RUN], output=str(tmp_path / "usage-report.parquet"))
    saved = spark.read.parquet(str(tmp_path / "usage-report.parquet"))
    extra = ["JobRoot", "JobInfoType", "MaxRSS_unit", "MaxRSS_G", "ReqMem_unit", "ReqMem_G", "MemEfficiencyRatio",
             "MemEfficiencyPercent", "TotalCPU_seconds", "CPUEfficiencyPercent", "rule_name", "wildcards"]
    assert set(saved.columns) == {*ACCOUNTING_COLUMNS, *extra, "date"}
    assert report.statistics.first().rule_name == "vidjil"


def test_conform_and_subsets(spark):
    df = spark.createDataFrame([("1", 5, "x")], "JobID string, ElapsedRaw int, other string")
    whole = conform(df)
    assert whole.columns == [*ACCOUNTING_COLUMNS, "other"] and dict(whole.dtypes)["ElapsedRaw"] == "bigint"
    assert column_subset(whole, USEFUL_COLUMNS).columns == USEFUL_COLUMNS
    assert conform(df, keep_extra=False).columns == ACCOUNTING_COLUMNS


def day_counts(spark, table):
    return {str(r.date): r["count"] for r in scan_table(spark, table).groupBy("date").count().collect()}


def test_streamed_and_batch_ingest_share_a_table(spark, tmp_path):
    dumps, batch, table = tmp_path / "dumps", tmp_path / "batch", str(tmp_path / "table")
    dumps.mkdir(), batch.mkdir()
    write_dump(batch / "2026-01-14.csv", sample_lines("2026-01-14", 20000))
    ingest(spark, str(batch / "2026-01-14.csv"), table)
    write_dump(dumps / "2026-01-15.csv", [*sample_lines(), "broken|line"])
    checkpoint = str(tmp_path / "checkpoint")
    start_ingest(spark, str(dumps), table, checkpoint).awaitTermination()
    assert day_counts(spark, table) == {"2026-01-14": 3, "2026-01-15": 3}
    write_dump(dumps / "2026-01-16.csv", sample_lines("2026-01-16", 40000))
    start_ingest(spark, str(dumps), table, checkpoint).awaitTermination()
    write_dump(batch / "2026-01-17.csv", sample_lines("2026-01-17", 50000))
    ingest(spark, str(batch / "2026-01-17.csv"), table)
    wanted = {f"2026-01-{d}": 3 for d in (14, 15, 16, 17)}
    assert day_counts(spark, table) == wanted
    ingest(spark, str(dumps / "2026-01-16.csv"), table, replace_days=True)
    assert day_counts(spark, table) == wanted
    # a stream whose checkpoint is lost reads all dumps again and adds none twice
    start_ingest(spark, str(dumps), table, str(tmp_path / "fresh")).awaitTermination()
    assert day_counts(spark, table) == wanted
    rows = scan_table(spark, table)
    assert rows.where("_src is null").isEmpty()
    check_sample_report(generic_report(rows.where("date = '2026-01-15'").drop("date")))


def test_log_path_patterns(spark, tmp_path):
    for name in ("a1.log", "a2.log"):
        (tmp_path / name).write_text(f"line of {name}\n")
    for pattern in ("a*.log", "a?.log", "a[12].log", "a{1,2}.log"):
        assert read_log_lines(spark, [str(tmp_path / pattern)]).count() == 2
    found = read_log_lines(spark, [str(tmp_path / "a1.log"), str(tmp_path / "gone.log"), str(tmp_path / "b*.log")])
    assert [r.line for r in found.collect()] == ["line of a1.log"]


def test_run_days_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"2026-01-{i:02d}") for i in range(10, 20)], "JobID string, date string")
    sinks.write_accounting_table(rows.withColumn("date", F.col("date").cast("date")), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    text = "[Thu Jan 15 10:00:00 2026]\n[Fri Jan 16 10:00:00 2026]\n[Thu Jan 15 11:00:00 2026]"
    lines = lines_of_texts(spark.createDataFrame([("/l", text)], "log_path string, content string"))
    found = collect_run_days(table, lines)
    assert sorted(r.JobID for r in found.collect()) == ["15", "16"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    dates = spark.createDataFrame([(dt.date(2026, 1, 12),)], "date date")
    assert [r.JobID for r in rows_of_dates(table, dates).collect()] == ["12"]
