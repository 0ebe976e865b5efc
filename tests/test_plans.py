"""Physical plans: shuffles, pruning, and the same results whatever the join strategy."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobtally import session
from jobtally.operators import inputs, logs, rules
from jobtally.operators.columns import add_cpu_seconds
from jobtally.plans.daily_report import daily_report
from jobtally.plans.generic import generic_report
from jobtally.plans.ingest import typed_rows
from jobtally.plans.period_report import period_report_from_accounting
from jobtally.registry import views
from jobtally.schema import conform
from jobtally.session import materialize
from jobtally.sources import accounting, clustered, sinks

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "accounting")
    sinks.write_accounting_table(conform(views.accounting_rows(spark, SF_DIR)), path)
    return path


@pytest.fixture
def conf(spark):
    saved = {}

    def set_all(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            saved.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single)", plan(df)))


def read_columns(df):
    return sorted(set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>\n", plan(df) + "\n").group(1))))


def test_generic_report_shuffles_once(spark, table):
    report = generic_report(spark.read.parquet(table))
    assert exchanges(report) == 1
    assert "partial_min_by" in plan(report) and "partial_max" in plan(report)
    narrow = report.select("JobRoot", "MemEfficiencyPercent")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        assert read_columns(narrow) == ["JobID", "MaxRSS", "ReqMem"]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_clustered_table_is_collapsed_without_a_shuffle(spark, tmp_path):
    rows = conform(views.accounting_rows(spark, SF_DIR))
    clustered.write_clustered_table(rows, "clustered_plain", str(tmp_path / "plain"), 4)
    clustered.write_clustered_table(rows, "clustered_crowded", str(tmp_path / "crowded"), 4, most_rows=4)
    plain, crowded = (clustered.scan_clustered_table(spark, n) for n in ("clustered_plain", "clustered_crowded"))
    assert plain.crowded.isEmpty() and not crowded.crowded.isEmpty() and not crowded.jobs.isEmpty()
    assert exchanges(generic_report(plain.jobs)) == 0
    assert exchanges(generic_report(plain.jobs, ["date", "JobRoot"])) == 0
    assert exchanges(generic_report(plain)) == 1  # of the crowded jobs, of which there are none here
    wanted = generic_report(rows).select("JobRoot", "JobID", "QOS", "NodeList", "MaxRSS", "TotalCPU", "MemEfficiencyPercent")
    for table in (plain, crowded):
        assert rows_of(generic_report(table).select(*wanted.columns)) == rows_of(wanted)
        assert rows_of(daily_report(table)) == rows_of(daily_report(rows))
    some = crowded.where("date >= '1997-01-01'")
    assert rows_of(daily_report(some)) == rows_of(daily_report(rows.where("date >= '1997-01-01'")))
    for name in ("clustered_plain", "clustered_crowded"):
        clustered.drop_clustered_table(spark, name)


def test_daily_report_reads_only_its_columns(spark, table):
    rows = accounting.scan_table(spark, table).where(F.col("date") == F.lit("1997-01-15").cast("date"))
    report = daily_report(rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        text = plan(report)
        assert set(read_columns(report)) - {"_src", "file", "block", "row", "struct"} == {
            "JobID", "MaxRSS", "TotalCPU", "ElapsedRaw", "Start", "End", "Submit", "State", "QOS",
        }
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert exchanges(report) == 2
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ = 1997-01-15", text)


def test_period_report_prunes_days(spark, table):
    report = period_report_from_accounting(accounting.scan_table(spark, table), "1997-01-01", "1997-01-31")
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= 1997-01-01", plan(report.series))


def test_logs_in_rows_need_no_shuffle(spark):
    texts = spark.range(4).select(F.concat(F.lit("/l"), "id").alias("log_path"), F.lit("[x]\nrule a:").alias("content"))
    assert exchanges(logs.log_records_of_texts(texts)) == 0
    assert exchanges(logs.run_ids_of_texts(texts)) == 0


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_same_results_without_broadcast(spark, table, conf):
    allocations = materialize(
        generic_report(spark.read.parquet(table))
        .withColumn("rule_name", F.when(F.col("JobRoot").endswith("7"), "cold").otherwise("hot"))
        .withColumn("MemEfficiencyPercent", F.round(F.coalesce("MemEfficiencyPercent", F.lit(0.0)), 2))
    )
    sizes = views.size_rows(spark, SF_DIR)

    def results():
        exact = rules.aggregate_per_rule(allocations).select(
            "rule_name", "MemEfficiencyPercent_median", "ElapsedRaw_median", "ElapsedRaw_max", "QOS"
        )
        shape = rules.rule_distribution(allocations, "ElapsedRaw")
        joined = inputs.enrich_with_input_sizes(allocations, sizes).select("JobRoot", "inputs", "MinPerMo")
        return rows_of(exact), rows_of(shape), rows_of(joined)

    broadcast = results()
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
         spark__sql__shuffle__partitions="5")
    text = plan(rules.rule_distribution(allocations, "ElapsedRaw"))
    assert "SortMergeJoin" in text and "_salt" in text
    assert results() == broadcast


def test_salted_join_spreads_a_hot_rule(spark, conf):
    """With broadcasts off, the rows of one rule reach many shuffle partitions."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__enabled="false")
    rows = spark.range(3000).select(
        F.lit("hot").alias("rule_name"), F.col("id").cast("string").alias("JobRoot"), F.rand(1).alias("x")
    )
    from jobtally.operators.quantiles import attach_group_rows

    groups = rows.groupBy("rule_name").agg(F.max("x").alias("top"))
    joined = attach_group_rows(rows, groups, ["rule_name"], ["JobRoot"])
    assert joined.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert joined.count() == 3000


def test_ingest_splits_a_line_once(spark):
    text = plan(typed_rows(spark.read.text(f"{SF_DIR}/orders.parquet").toDF("line")))
    assert text.count("split(") == 1


def test_hot_input_path_is_split(spark, conf):
    """A third of the records name one file and a third none: AQE cuts the hot partition."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )
    n = 90_000
    i = F.col("id")
    paths = (
        F.when(i % 3 == 0, F.array(F.lit("/ref/genome")))
        .when(i % 3 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("/d/"), i)))
    )
    records = spark.range(0, n, 1, 8).select(
        F.concat(F.lit("/l/"), i).alias("log_path"), F.lit(1).alias("record_no"), i.cast("string").alias("slurm_jobid"),
        F.lit("1").alias("job_id"), F.lit("r").alias("rule_name"), paths.alias("inputs"),
        F.lit(None).cast("string").alias("project_dir"),
    )
    files = spark.range(0, n, 1, 8).select(F.concat(F.lit("/d/"), i).alias("path"), i.alias("length"))
    manifest = files.union(spark.createDataFrame([("/ref/genome", 5)], "path string, length bigint"))
    sizes = inputs.input_sizes(records, manifest)
    rows = sizes.collect()
    assert len(rows) == n
    assert sum(r.input_size_bytes for r in rows) == sum(range(2, n, 3)) + 5 * (n // 3)
    assert "skew=true" in plan(sizes)


def test_clustered_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "JobID string, State string"
    rows = [("1", "a"), ("1.batch", "b"), ("2", "c"), ("2.0", "d"), ("2.1", "e"), (None, "f")]
    df = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    clustered.write_clustered_table(df, "clustered_once", str(tmp_path / "once"), 2, most_rows=2)
    parts = clustered.scan_clustered_table(spark, "clustered_once")
    assert (parts.jobs.count(), parts.crowded.count(), seen.value) == (3, 3, 6)
    clustered.drop_clustered_table(spark, "clustered_once")


def test_clustered_rows_are_shuffled_in_parts(spark, tmp_path, monkeypatch):
    parts = []

    def every_part(df, number):
        for part in session.in_parts(df, number, most_bytes=0):
            parts.append(part.count())
            yield part

    monkeypatch.setattr(clustered, "in_parts", every_part)
    rows = views.accounting_rows(spark, SF_DIR).withColumn("JobID", F.when(~F.col("JobID").startswith("x"), F.col("JobID")))
    folder = Path(session.checkpoint_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    clustered.write_clustered_table(rows, "clustered_parts", str(tmp_path / "parts"), 8, most_rows=7)
    kept = [spark.read.parquet(str(p)).columns for p in set(folder.iterdir()) - before]
    assert len(parts) == 4 and min(parts) > 0 and sum(parts) == rows.count()
    assert kept == [["_crowd"]] * 4  # the stored rows are gone
    found = clustered.scan_clustered_table(spark, "clustered_parts")
    assert len(list((tmp_path / "parts" / "jobs").glob("part-*.parquet"))) == 8  # a file a bucket
    assert exchanges(generic_report(found.jobs)) == 0 and not found.crowded.isEmpty()
    wanted = generic_report(rows).select("JobRoot", "JobID", "QOS", "NodeList", "MaxRSS", "TotalCPU", "MemEfficiencyPercent")
    assert rows_of(generic_report(found).select(*wanted.columns)) == rows_of(wanted)
    clustered.drop_clustered_table(spark, "clustered_parts")


def test_days_are_collapsed_in_the_order_of_jobs(spark, table):
    report = generic_report(spark.read.parquet(table), ["date", "JobRoot"])
    assert report.columns[:2] == ["date", "JobRoot"]
    assert re.findall(r"SortAggregate\(key=\[(\w+)#\d+, (\w+)#", plan(report)) == [("JobRoot", "date")] * 2


def test_cpu_time_is_matched_once(spark):
    texts = ["1-02:03:04", "02:03:04", "03:04.5", "1-2-3:4:5", "1:2:3:4", "7:8.", "99999999999999999999:00:00", None]
    seconds = add_cpu_seconds(spark.createDataFrame([(t,) for t in texts], "TotalCPU string").repartition(2))
    assert "regexp_extract(" not in plan(seconds)
    got = {r.TotalCPU: r.TotalCPU_seconds for r in seconds.collect()}
    assert [got[t] for t in texts] == [93784, 7384, 184, 0, 0, 0, None, 0]


def test_rows_that_all_have_a_place_are_ordered_by_it_alone(spark):
    rows = views.accounting_rows(spark, SF_DIR)
    some = rows.withColumn("_src", F.when(F.lit(1) == F.length("JobID") - F.length("JobID") + 1, F.col("_src")))
    assert not rows.schema["_src"].nullable and some.schema["_src"].nullable
    plain, tied = (generic_report(r, ["date", "JobRoot"]) for r in (rows, some))
    assert "struct(_place" not in plan(plain) and "struct(_place" in plan(tied)
    assert rows_of(plain) == rows_of(tied)
