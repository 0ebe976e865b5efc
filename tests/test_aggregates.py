"""Grouped operators: allocations, rules, quantiles, daily metrics, documents."""

import json
import math
import random
import statistics
import struct
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from jobtally.operators import daily, documents, period, quantiles, rules, tables
from jobtally.operators.allocations import aggregate_per_alloc
from jobtally.operators.columns import add_job_columns
from jobtally.operators.quantiles import Quantile, exact_quantiles
from jobtally.plans.daily_report import daily_report
from jobtally.plans.generic import generic_report
from jobtally.plans.log_inputs import log_input_sizes_of_texts
from jobtally.plans.period_report import period_report
from jobtally.plans.rule_report import rule_report
from jobtally.registry import views
from jobtally.session import checkpoint_folder, in_parts


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_alloc_largest_number_and_first_text(spark):
    df = spark.createDataFrame(
        [("100", 4, 100, 45.5, "normal", "bio"), ("100", 8, 200, 78.2, None, "bio"),
         ("200", 2, 50, float("nan"), "high", "chem"), ("200", 1, 10, 3.5, None, None)],
        "JobRoot string, AllocCPUS bigint, ElapsedRaw bigint, MemEfficiencyPercent double, QOS string, Account string",
    )
    got = by(aggregate_per_alloc(df), "JobRoot")
    assert (got["100"].AllocCPUS, got["100"].ElapsedRaw, got["100"].QOS, got["100"].Account) == (8, 200, "normal", "bio")
    assert got["100"].MemEfficiencyPercent == 78.2
    assert (got["200"].QOS, got["200"].Account, got["200"].MemEfficiencyPercent) == ("high", "chem", 3.5)


def test_alloc_order_is_by_kind_not_arrival(spark):
    run = "59b3d4de-2b08-4a7c-a78d-3f2c8560439c"
    rows = [("7.10", "step10", "n10", None), ("7.2", "step2", "n2", "s2"), ("7.extern", "extern", "nx", None),
            ("7.batch", "batch", None, None), ("7", run, None, None), ("7.abc", "u", "nu", "su")]
    df = spark.createDataFrame(rows, "JobID string, JobName string, NodeList string, State string")
    for seed in range(3):
        shuffled = df.orderBy(F.rand(seed)).repartition(5)
        got = aggregate_per_alloc(add_job_columns(shuffled)).first()
        assert (got.JobID, got.JobName, got.NodeList, got.State) == ("7", run, "nx", "s2")
        assert got.JobInfoType == "allocation"


def test_alloc_name_needs_run_id_length(spark):
    df = spark.createDataFrame([("1", "short"), ("1", None)], "JobRoot string, JobName string")
    assert aggregate_per_alloc(df).first().JobName is None


def test_generic_report_cases(spark):
    df = spark.createDataFrame(
        [("100", "2G", "4G", "1:00:00", 3600, 2, "normal", "bio", "node1"),
         ("200", "1G", "2G", "0:30:00", 1800, 4, "high", "chem", "node2"),
         ("300", "1G", "2G", "0:36:00", 3600, 1, "normal", "bio", "node1"),
         ("400", "512K", "4G", "0:30:00", 1800, 4, "normal", "bio", "node1"),
         ("400.batch", "1024K", "4G", "1:00:00", 3600, 4, "normal", "bio", "node1")],
        "JobID string, MaxRSS string, ReqMem string, TotalCPU string, CPUTimeRAW bigint, AllocCPUS bigint,"
        "QOS string, Account string, NodeList string",
    )
    got = by(generic_report(df), "JobRoot")
    assert len(got) == 4
    assert got["100"].MemEfficiencyPercent == 50.0 and got["100"].CPUEfficiencyPercent == 100.0
    assert got["300"].CPUEfficiencyPercent == 60.0
    assert got["400"].MaxRSS == 1048576 and got["400"].MaxRSS_G == 1048576 / 1024**3
    assert got["400"].TotalCPU_seconds == 1800 and got["400"].CPUEfficiencyPercent == 50.0


RULES = (
    "JobRoot string, rule_name string, MemEfficiencyPercent double, CPUEfficiencyPercent double, ElapsedRaw bigint,"
    "Elapsed string, QOS string, Account string, NodeList string, UsedRAMPerMo double, MinPerMo double"
)


def rule_frame(spark):
    return spark.createDataFrame(
        [("10", "align", 50.0, 60.0, 100, "00:02:25", None, "bio", "n1", 1.0, 2.0),
         ("9", "align", 60.0, 70.0, 200, "00:03:20", "normal", None, "n2", 3.0, 4.0),
         ("8", "align", 70.0, 80.0, 150, "9-00:00:00", "high", "bio2", "n3", 5.0, 9.0),
         ("2", "sort", float("nan"), 10.0, 5, "00:00:05", None, None, None, None, None),
         ("1", "sort", 20.0, 30.0, 7, "00:00:07", None, None, None, 1.0, float("inf"))],
        RULES,
    )


def test_rule_statistics(spark):
    got = by(rules.aggregate_per_rule(rule_frame(spark), input_sizes=True), "rule_name")
    align, sort = got["align"], got["sort"]
    assert (align.MemEfficiencyPercent_mean, align.MemEfficiencyPercent_median, align.MemEfficiencyPercent_std) == (60.0, 60.0, 10.0)
    assert (align.CPUEfficiencyPercent_mean, align.ElapsedRaw_max, align.ElapsedRaw_median) == (70.0, 200, 150.0)
    assert (align.Elapsed_min, align.Elapsed_max) == ("00:02:25", "9-00:00:00")
    # First in the order of job numbers, not of their text.
    assert (align.QOS, align.Account, align.NodeList) == ("high", "bio2", "n3")
    assert (align.UsedRAMPerMo_mean, align.MinPerMo_max) == (3.0, 9.0)
    assert math.isnan(sort.MemEfficiencyPercent_mean) and sort.MemEfficiencyPercent_max == 20.0
    assert sort.MinPerMo_mean == math.inf and sort.UsedRAMPerMo_std is None and sort.QOS is None
    assert "MinPerMo_mean" not in rules.aggregate_per_rule(rule_frame(spark)).columns


def test_distribution_and_outliers(spark):
    rows = [("a", float(v)) for v in [*range(1, 21), 100, 45]] + [("b", 1.0), ("b", 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "rule_name string, runtime double")
    shape = rules.rule_distribution(df, "runtime")
    got = by(shape, "rule_name")
    assert set(got) == {"a", "b"}
    values = sorted(v for r, v in rows if r == "a")
    q1, q2, q3 = statistics.quantiles(values, n=4, method="inclusive")
    assert (got["a"].q1, got["a"].median, got["a"].q3) == (q1, q2, q3)
    assert (got["a"].n_values, got["a"].min_value, got["a"].max_value) == (22, 1.0, 100.0)
    beyond = {r.runtime: r.suspected for r in rules.rule_outliers(df, shape, "runtime").collect()}
    high, far = q3 + 1.5 * (q3 - q1), q3 + 3 * (q3 - q1)
    assert beyond == {v: v > far for v in values if v > high or v < q1 - 1.5 * (q3 - q1)}
    assert [r.rule_name for r in rules.distinct_rules(df).collect()] == ["b", "a"]


@pytest.mark.parametrize("shape", ["uniform", "ties", "heavy", "infinite"])
def test_exact_quantiles_of_a_hot_group(spark, shape):
    """In one pass, and in many of a few bits each, against ``percentile``."""
    rng = random.Random(shape)
    draw = {
        "uniform": lambda: rng.random(),
        "ties": lambda: float(rng.randrange(5)),
        "heavy": lambda: rng.paretovariate(0.5),
        "infinite": lambda: rng.choice([math.inf, math.nan, rng.random()]),
    }[shape]
    rows = [("hot", i, draw()) for i in range(20_000)] + [(f"cold{i % 50}", i, draw()) for i in range(2_000)]
    rows += [(None, i, draw()) for i in range(7)] + [("empty", 0, None)]
    df = spark.createDataFrame(rows, "k string, id bigint, v double").repartition(6)
    wanted = [Quantile("p10", "v", 0.1), Quantile("p50", "v", 0.5), Quantile("p99", "v", 0.99)]
    plain = by(df.groupBy("k").agg(*[F.percentile("v", q.fraction).alias(q.name) for q in wanted]), "k")
    for options in ({}, {"bits": 7, "most_values": 10}):
        got = by(exact_quantiles(df, ["k"], wanted, ["id"], **options), "k")
        assert set(got) == set(plain)
        for key in plain:
            for q in wanted:
                a, b = got[key][q.name], plain[key][q.name]
                assert a == b or (math.isnan(a) and math.isnan(b)), (key, q.name, a, b)


def test_order_key_is_the_order_of_doubles(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1.0, 2.0]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)]
    values += [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1073, 1024)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_key(F.col("v")).alias("k")).collect()
    for row in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(row.v)))[0]
        assert row.k == (bits if row.v > 0 else -bits), row
    assert spark.sql("SELECT double('NaN') AS v").select(quantiles.order_key(F.col("v"))).first()[0] > max(r.k for r in rows)


def test_quantiles_of_nothing_and_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 3.0, None), ("b", 3, None, None)], "k string, id int, v double, w double")
    wanted = [Quantile("half", "v", 0.5), Quantile("low", "v", 0.0), Quantile("none", "w", 0.5), Quantile("ids", "id", 0.25)]
    got = by(exact_quantiles(df, ["k"], wanted, ["id"]), "k")
    assert tuple(got["a"])[1:] == (2.0, 1.0, None, 1.25) and tuple(got["b"])[1:] == (None, None, None, 3.0)
    assert exact_quantiles(df.limit(0), ["k"], wanted, ["id"]).count() == 0


def test_run_filters(spark):
    a, b = "8f14e45f-ceea-167a-5a36-dedd4bea2543", "6512bd43-d9ca-a6e0-2c99-0b0a82652dca"
    df = spark.createDataFrame([(a,), (b,), ("other",), (None,)], "JobName string")

    def names(d):
        return sorted(r.JobName for r in d.collect())

    assert names(rules.filter_runs(df, [a], "all")) == [a]
    assert names(rules.filter_runs(df, [a, b], "all")) == []
    assert names(rules.filter_runs(df, [a, b], "any")) == sorted([a, b])
    assert names(rules.filter_runs(df, ["^8f", "oth"], "any")) == sorted([a, "other"])
    assert names(rules.filter_runs(df, [], "any")) == []
    assert rules.filter_runs(df, [], "all").count() == 4
    ids = spark.createDataFrame([(a,), (a,)], "run_id string")
    assert names(rules.filter_runs_in(df, ids)) == [a]
    with pytest.raises(ValueError):
        rules.filter_runs(df, [a], "some")


ACCOUNTING = (
    "date string, JobID string, QOS string, State string, Submit string, Start string, End string,"
    "ElapsedRaw bigint, MaxRSS string, ReqMem string, TotalCPU string, CPUTimeRAW bigint"
)


def accounting(spark, rows):
    return spark.createDataFrame(rows, ACCOUNTING).withColumn("date", F.col("date").cast("date"))


def day_rows():
    d = "2026-01-15"
    return [
        (d, "1", "routine", "COMPLETED", f"{d}T10:00:00", f"{d}T10:01:00", f"{d}T11:01:00", 3600, None, "4G", "1:00:00", 3600),
        (d, "1.batch", None, "COMPLETED", f"{d}T10:01:00", f"{d}T10:01:00", f"{d}T11:01:00", 3600, "2G", None, "00:01.983", 3600),
        (d, "2", "routine", "FAILED", "2026-01-14T23:00:00", f"{d}T00:00:00", f"{d}T00:10:00", 600, "512M", "1G", "0:10:00", 600),
        (d, "3", None, "CANCELLED by 1009", f"{d}T12:00:00", "Unknown", "Unknown", None, None, "1G", None, None),
        (d, "4", "long", "PREEMPTED", f"{d}T12:00:00", f"{d}T12:00:30", "2026-01-16T01:00:00", 46770, "3000M", "4G", "bad", 0),
    ]


def test_daily_metrics(spark):
    got = {(r.scope, r.QOS): r for r in daily_report(accounting(spark, day_rows())).collect()}
    assert set(got) == {("global", None), ("qos", "routine"), ("qos", None), ("qos", "long")}
    g = got["global", None]
    assert g.cpu_seconds == 4200 and g.cpu_hours == 4200 / 3600
    assert g.cpu_percent == 4200 / 36633600 * 100
    gb = [2 * 3600, 0.5 * 600, 3000 / 1024 * 46770]
    assert g.gb_seconds == sum(gb)
    assert g.ram_percent == (2 * 3600 + 0 + 2 * 46770) / 188611200 * 100
    assert (g.wait_mean, g.wait_median, g.wait_min, g.wait_max) == ((60 + 3600 + 30) / 3, 60.0, 30, 3600)
    assert (g.submitted, g.started, g.ended) == (3, 3, 2)
    assert (g.succeeded, g.failed, g.preempted) == (1, 1, 1)
    assert (g.duration_mean, g.duration_min, g.duration_max) == ((3600 + 600 + 46770) / 3, 600.0, 46770.0)
    none = got["qos", None]
    assert (none.cpu_seconds, none.gb_seconds, none.submitted, none.wait_mean) == (0, 0.0, 1, None)
    exact = {(r.scope, r.QOS): r for r in daily_report(accounting(spark, day_rows()), exact_gb=True).collect()}
    assert exact["global", None].ram_percent == sum(gb) / 188611200 * 100


def test_daily_capacity(spark):
    rows = day_rows() + [("2026-01-16", *r[1:]) for r in day_rows()]
    table = spark.createDataFrame([("2026-01-15", 4200, 1000)], "date string, cpu_secondes bigint, gb_secondes bigint")
    table = table.withColumn("date", F.col("date").cast("date"))
    got = {str(r.date): r for r in daily_report(accounting(spark, rows), table).collect() if r.scope == "global"}
    assert got["2026-01-15"].cpu_percent == 100.0
    assert got["2026-01-16"].cpu_percent == 420000.0
    missing = {r.scope: r for r in daily_report(accounting(spark, day_rows()[:1]), {}).collect()}
    assert missing["global"].cpu_percent == 360000.0


def test_documents(spark):
    metrics = daily_report(accounting(spark, day_rows()))
    document = json.loads(documents.daily_documents(metrics).first().document)
    assert set(document) == {"global", "routine", "", "long"}
    assert list(document["global"]) == list(daily.METRIC_LABELS.values())
    assert document["global"]["Jobs soumis"] == 3 and document[""]["CPU.Secondes"] == 0
    assert document[""]["Temps d'attente moyen en queue (secondes)"] is None
    labelled = daily.with_report_labels(metrics)
    assert labelled.columns[3:] == list(daily.METRIC_LABELS.values())
    assert daily.global_rows(metrics).count() == 1 and daily.qos_rows(metrics).count() == 3
    clash = [(r[0], r[1], "global", *r[3:]) for r in day_rows()[:1]]
    with pytest.raises(Exception, match="called 'global'"):
        documents.daily_documents(daily_report(accounting(spark, clash))).collect()


def test_document_metrics(spark):
    ram, cpu = period.PERIOD_METRICS
    texts = [
        ("2026-01-01", json.dumps({"global": {ram: 1.5, cpu: None}, "x": {ram: 9}})),
        ("2026-01-02", json.dumps({"global": 3})),
        ("2026-01-03", json.dumps({"x": {}})),
        ("2026-01-04", json.dumps({"global": {}})),
        ("2026-01-05", json.dumps({"global": {ram: 4, cpu: 2.25}}, indent=2)),
        ("2026-01-09", json.dumps({"global": {ram: 100, cpu: 100}})),
    ]
    df = spark.createDataFrame(texts, "date string, document string").withColumn("date", F.col("date").cast("date"))
    report = period_report(documents.document_metrics(df), "2026-01-01", "2026-01-05")
    ranges = by(report.ranges, "metric")
    assert (ranges[ram].min_value, ranges[ram].max_value) == (0.0, 4.0)
    assert (ranges[cpu].min_value, ranges[cpu].max_value) == (0.0, 2.25)
    assert ranges[ram].title == period.PERIOD_METRICS[ram]
    assert report.num_days.first().num_days == 2
    series = [(str(r.date), r.value) for r in report.series.collect() if r.metric == ram]
    assert series == [("2026-01-01", 1.5), ("2026-01-02", 0.0), ("2026-01-04", 0.0), ("2026-01-05", 4.0)]


def test_columnar_json(spark):
    df = spark.createDataFrame(
        [(3, "c", True, 3.5), (1, "a", False, 1.5), (2, None, None, None)], "a int, b string, f boolean, v double"
    ).withColumn("d", F.lit("2026-01-02").cast("date"))
    got = json.loads(documents.columnar_json(df, ["a"]).first().document)
    assert got == {"a": [1, 2, 3], "b": ["a", None, "c"], "f": [False, None, True], "v": [1.5, None, 3.5],
                   "d": ["2026-01-02"] * 3}
    assert json.loads(documents.columnar_json(df.where("a > 9"), ["a"]).first().document)["a"] == []


def test_union_by_name_keeps_text(spark):
    a = spark.createDataFrame([("12.batch", 5)], "JobID string, ElapsedRaw int")
    b = spark.createDataFrame([(13, "00:01")], "JobID bigint, Elapsed string")
    got = tables.union_by_name([a, b])
    assert dict(got.dtypes) == {"JobID": "string", "ElapsedRaw": "bigint", "Elapsed": "string"}
    assert sorted(map(tuple, got.collect())) == [("12.batch", 5, None), ("13", None, "00:01")]


def test_malformed_lines(spark):
    df = spark.createDataFrame([("a|b|c",), ("a|b",), ("",), ("a|b|",), ("a|b|c|d",)], "line string")
    assert sorted(r.line for r in tables.drop_malformed_lines(df, 3).collect()) == ["a|b|", "a|b|c"]
    assert tables.count_malformed_lines(df, 3).first().removed_lines == 3
    multi = spark.createDataFrame([("a::b::c",), ("a:b",)], "line string")
    assert [r.line for r in tables.drop_malformed_lines(multi, 3, "::").collect()] == ["a::b::c"]


def test_rule_report_tables(spark):
    rows = [
        (str(i), None, f"rule_{'abc'[i % 3]}", "2G", "4G", "1:00:00", 3600 + i, 3600 + i, "01:00:00", "q", "acc", "n")
        for i in range(30)
    ]
    df = spark.createDataFrame(
        rows, "JobID string, JobName string, Comment string, MaxRSS string, ReqMem string, TotalCPU string,"
        "CPUTimeRAW bigint, ElapsedRaw bigint, Elapsed string, QOS string, Account string, NodeList string",
    )
    sizes = spark.createDataFrame([(i, 1048576 * (i + 1), f"/f{i}") for i in range(30)],
                                  "slurm_jobid bigint, input_size_bytes bigint, inputs string")
    report = rule_report(df, None, sizes)
    assert set(report.tables) == {"mem", "cpu", "runtime", "relative_mem", "relative_runtime"}
    table = report.tables["runtime"]
    assert table.columns == ["Nom de la règle", "Durée moyenne", "Durée médiane", "Durée (écart-type)",
                             "Durée minimum", "Durée maximum"]
    assert [r[0] for r in table.collect()] == ["a", "b", "c"]
    assert report.allocations.count() == 30
    shapes = {(r.metric, r.rule_name): r for r in report.distributions.collect()}
    assert len(shapes) == 15 and shapes["UsedRAMPerMo", "a"].max_value == 4096.0
    assert set(rule_report(df, None).tables) == {"mem", "cpu", "runtime"}


def test_one_meaning_of_matching(spark):
    run = "8f14e45f-ceea-167a-5a36-dedd4bea2543"
    names = spark.createDataFrame([(run,), (f"pre-{run}",), (run[:-1],)], "JobName string")
    assert rules.filter_runs(names, [run], "all").count() == 2
    assert rules.filter_runs(names, [run], "any").count() == 2
    assert [r.JobName for r in rules.filter_runs(names, [run], "exact").collect()] == [run]


def test_runs_are_narrowed_before_the_collapse(spark):
    run, other = "8f14e45f-ceea-167a-5a36-dedd4bea2543", "6512bd43-d9ca-a6e0-2c99-0b0a82652dca"
    rows = [("1", run), ("1.batch", "batch"), ("2", other), ("2.0", "python"), (None, run), ("3", other), ("3.1", run)]
    jobs = add_job_columns(spark.createDataFrame(rows, "JobID string, JobName string"))
    kept = rules.rows_of_runs(jobs, [f"^{run[:8]}"])
    assert sorted((r.JobID or "") for r in kept.collect()) == ["", "1", "1.batch", "3", "3.1"]
    assert rules.rows_of_runs(jobs, jobs.selectExpr(f"'{run}' as run_id").limit(1)).count() == 5


def test_rows_without_a_place_do_not_depend_on_arrival(spark):
    rows = [("7", name, None) for name in ("b", "a", "c")] + [("7", "z", {"file": "f", "block": 0, "row": 1})]
    schema = "JobID string, Account string, _src struct<file:string,block:bigint,row:bigint>"
    found = set()
    for turn in range(3):
        df = spark.createDataFrame(rows[turn:] + rows[:turn], schema).coalesce(1)
        found.add(aggregate_per_alloc(add_job_columns(df)).first().Account)
    assert len(found) == 1


def test_quantiles_of_one_value_take_no_further_pass(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(quantiles, "materialize", lambda df: stored.append(1) or df.localCheckpoint())
    rows = [("a", i, 5.0) for i in range(300)] + [("b", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = by(exact_quantiles(df, ["k"], [Quantile("half", "v", 0.5), Quantile("low", "v", 0.1)], ["id"], bits=16, most_values=50), "k")
    assert tuple(got["a"])[1:] == (5.0, 5.0) and (got["b"].half, round(got["b"].low, 9)) == (19.5, 3.9)
    assert len(stored) == 2  # the counts and the brackets of the first pass


def test_quantiles_pass_over_nulls_next_to_values(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, None, 1.0, None, None, None, 2.0])]
    rows += [("b", i, v) for i, v in enumerate([None, float("nan"), 1.0, float("-inf"), None])]
    df = spark.createDataFrame(rows, "k string, id int, v double")
    got = by(exact_quantiles(df, ["k"], [Quantile("half", "v", 0.5), Quantile("most", "v", 1.0)], ["id"], bits=8, most_values=1), "k")
    assert tuple(got["a"])[1:] == (2.0, 3.0) and got["b"].half == 1.0 and math.isnan(got["b"].most)


def test_report_parts_are_found_when_asked_for(spark, monkeypatch):
    from jobtally.plans import rule_report as plan

    asked = []
    monkeypatch.setattr(plan.rules, "rule_quartiles", lambda *a: asked.append("quartiles"))
    df = spark.createDataFrame(
        [("1", None, "rule_a", "2G", "4G", "1:00:00", 3600, 3600, "01:00:00", "q", "acc", "n")],
        "JobID string, JobName string, Comment string, MaxRSS string, ReqMem string, TotalCPU string,"
        "CPUTimeRAW bigint, ElapsedRaw bigint, Elapsed string, QOS string, Account string, NodeList string",
    )
    assert rule_report(df, None).allocations.count() == 1 and not asked


def test_report_rows_are_collapsed_in_parts(spark, tmp_path, monkeypatch):
    from jobtally.plans import rule_report as plan

    parts = []

    def every_part(df, number):
        for part in in_parts(df, number, most_bytes=0):
            parts.append((part.count(), part.schema["_src"].nullable))
            yield part

    monkeypatch.setattr(plan, "in_parts", every_part)
    sf = "/root/testdata/sf0.001"
    rows, sizes = views.accounting_rows(spark, sf), log_input_sizes_of_texts(views.log_texts(spark, sf), views.manifest(spark, sf))
    report = rule_report(rows, None, sizes, output=str(tmp_path / "report"))
    assert len(parts) == 4 and sum(n for n, _ in parts) == rows.count() and not any(nullable for _, nullable in parts)
    wanted = plan.run_allocations(rows, None, sizes)
    assert report.allocations.dtypes == wanted.dtypes and report.allocations.count() == wanted.count()
    assert report.allocations.exceptAll(wanted).isEmpty()
    kept = Path(checkpoint_folder(spark))
    assert not list(kept.glob("jobtally-*/_part=*"))
    with pytest.raises(AnalysisException):
        rule_report(rows, None, sizes, output=str(tmp_path / "report"))
