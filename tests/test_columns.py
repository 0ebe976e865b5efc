"""Row-by-row operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from jobtally.functions import numbers, text, times
from jobtally.operators import columns


def values(df, name):
    return [row[name] for row in df.collect()]


def frame(spark, name, items, kind="string"):
    return spark.createDataFrame([(v,) for v in items], f"{name} {kind}").coalesce(1)


def test_job_columns(spark):
    ids = ["80417", "80417.batch", "80417.extern", "80417.0", "80417.42", "80417.abc",
           "123_4", "123_4.batch", "abc", None]
    got = columns.add_job_columns(frame(spark, "JobID", ids)).collect()
    assert [r.JobRoot for r in got] == ["80417"] * 6 + ["123", "123", None, None]
    assert [r.JobInfoType for r in got] == [
        "allocation", "batch", "extern", "step", "step", "unknown",
        "allocation", "allocation", "allocation", "allocation",
    ]
    assert "_suffix" not in columns.add_job_columns(frame(spark, "JobID", ids)).columns


def test_rule_columns(spark):
    comments = ["rule_trim_wildcards_s7", "rule_index", "note to self", None,
                "rule_call_peaks_wildcards_lib3_rep2", "rule_", "rule_q_wildcards_",
                "rule_dedup_wildcards__x_991231", "see rule_x"]
    got = columns.add_rule_columns(frame(spark, "Comment", comments)).collect()
    assert [(r.rule_name, r.wildcards) for r in got] == [
        ("trim", "s7"), ("index", ""), ("", ""), ("", ""), ("call_peaks", "lib3_rep2"), (None, ""),
        ("q_wildcards_", ""), ("dedup", "_x_991231"), ("", ""),
    ]


def test_sizes(spark):
    sizes = ["512K", "1024M", "8G", "2T", "unknown", None, "132.77M", "1.5G", "0",
             "99999999999999999999K"]
    split = columns.split_size_unit(frame(spark, "MaxRSS", sizes), "MaxRSS").collect()
    assert [(r.MaxRSS, r.MaxRSS_unit) for r in split][:7] == [
        ("512", "K"), ("1024", "M"), ("8", "G"), ("2", "T"), (None, None), (None, None), ("77", "M"),
    ]
    got = columns.parse_size(frame(spark, "MaxRSS", sizes), "MaxRSS").collect()
    assert [r.MaxRSS for r in got] == [
        524288, 1073741824, 8 * 1024**3, 2 * 1024**4, 0, 0, 77 * 1024**2, 5 * 1024**3, 0, None,
    ]
    assert got[1].MaxRSS_G == 1.0 and got[4].MaxRSS_G == 0.0
    exact = columns.parse_size(frame(spark, "MaxRSS", ["1.5G", "132.77M"]), "MaxRSS", decimals=True)
    assert values(exact, "MaxRSS") == [3 * 1024**3 // 2, int(132.77 * 1024**2)]


def test_bytes_to_gb_in_place(spark):
    df = frame(spark, "MaxRSS", [1073741824, 2147483648, 0], "bigint")
    assert values(columns.bytes_to_gb(df, "MaxRSS", keep_original=False), "MaxRSS") == [1.0, 2.0, 0.0]


def test_cpu_seconds(spark):
    texts = ["4:07:09", "3-11:20:40", "44:59.250", "00:00:00", "59:59.999", "07:31", "9:08:07.25",
             "5-02:03:04.5", "n/a", None]
    got = values(columns.add_cpu_seconds(frame(spark, "TotalCPU", texts)), "TotalCPU_seconds")
    assert got == [14829, 300040, 2699, 0, 3599, 0, 0, 0, 0, 0]


def timed(spark, rows):
    return spark.createDataFrame(rows, "Submit string, Start string, End string").coalesce(1)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_wait_and_duration(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = timed(spark, [
            ("2031-07-10T08:00:00", "2031-07-10T10:00:00", "2031-07-10T14:30:00"),
            ("2026-03-29T01:30:00", "2026-03-29T02:30:00", "2026-03-29T03:30:00"),
            ("2031-07-10T10:00:00", "Unknown", "2031-07-10T10:00:00"),
            ("2031-07-10", "2031-07-10T10:00:00", None),
        ])
        got = columns.add_job_duration(columns.add_wait_time(df)).collect()
        assert [r.wait_time_seconds for r in got] == [7200, 3600, None, None]
        assert [r.wait_time_hours for r in got] == [2.0, 1.0, None, None]
        assert [r.job_duration_seconds for r in got] == [16200.0, 3600.0, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_daily_duration(spark):
    cases = [
        ("2027-07-10T06:15:00", "2027-07-10T09:45:00", 3.5),
        ("2027-07-09T19:00:00", "2027-07-10T01:15:00", 1.25),
        ("2027-07-10T18:00:00", "2027-07-11T03:00:00", 21599 / 3600),
        ("2027-07-08T05:00:00", "2027-07-12T05:00:00", 24.0),
        ("2027-07-07T11:00:00", "2027-07-08T11:00:00", 0.0),
        ("2027-07-11T01:00:00", "2027-07-11T02:00:00", 0.0),
        ("2027-07-10T00:00:00", "2027-07-11T00:00:00", 86399 / 3600),
        ("2027-07-10T13:00:00", "2027-07-10T13:45:00", 0.75),
        ("2027-07-10T13:00:00", "Unknown", 0.0),
        (None, "2027-07-10T13:00:00", 0.0),
    ]
    df = timed(spark, [(s, s, e) for s, e, _ in cases])
    got = columns.add_daily_duration(df, "2027-07-10").collect()
    assert [r.daily_duration_hours for r in got] == [h for _, _, h in cases]
    assert {str(r.date) for r in got} == {"2027-07-10"}


def test_explode_job_days_agrees_with_single_days(spark):
    df = timed(spark, [
        ("x", "2031-07-09T12:00:00", "2031-07-11T12:00:00"),
        ("y", "2031-07-10T10:00:00", "2031-07-10T14:00:00"),
        ("z", "Unknown", "2031-07-10T14:00:00"),
        ("backwards", "2031-07-11T10:00:00", "2031-07-10T14:00:00"),
    ])
    got = {(r.Submit, str(r.date)): r.daily_duration_hours for r in columns.explode_job_days(df).collect()}
    assert got == {
        ("x", "2031-07-09"): 43199 / 3600, ("x", "2031-07-10"): 24.0, ("x", "2031-07-11"): 12.0,
        ("y", "2031-07-10"): 4.0,
    }


def test_ieee_division(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 0.0), (1.0, None)], "n double, d double"
    ).coalesce(1)
    got = values(df.select(numbers.ieee_divide(F.col("n"), F.col("d")).alias("q")), "q")
    assert got[0] == 0.5 and got[1] == math.inf and math.isnan(got[2]) and got[3] == -math.inf
    assert got[4:] == [None, None]


def test_efficiencies(spark):
    df = spark.createDataFrame(
        [(2, 4, 2700, 3600), (0, 0, 0, 0), (1, 0, 5, 0), (1, 2, 1, None)],
        "MaxRSS bigint, ReqMem bigint, TotalCPU_seconds bigint, CPUTimeRAW bigint",
    ).coalesce(1)
    got = columns.add_cpu_efficiency(columns.add_memory_efficiency(df)).collect()
    assert got[0].MemEfficiencyPercent == 50.0 and got[0].CPUEfficiencyPercent == 75.0
    assert math.isnan(got[1].MemEfficiencyRatio) and got[1].CPUEfficiencyPercent == 0.0
    assert got[2].MemEfficiencyRatio == math.inf and got[2].CPUEfficiencyPercent == math.inf
    assert got[3].CPUEfficiencyPercent is None


def test_size_relative(spark):
    df = spark.createDataFrame(
        [(600, 1048576000, 1068204032, 104857600), (600, 1, 1, 0), (0, 0, 0, 0), (1, 1, 1, None)],
        "ElapsedRaw bigint, ReqMem bigint, MaxRSS bigint, input_size_bytes bigint",
    ).coalesce(1)
    got = columns.add_size_relative(df, used_memory=True).collect()
    assert (got[0].MinPerMo, got[0].UsedRAMPerMo) == (0.1, 10.0)
    assert got[0].MaxRSSPerMo == pytest.approx(10.1871875)
    assert got[1].MinPerMo == math.inf and math.isnan(got[2].MinPerMo) and got[3].MinPerMo is None


def test_bands(spark):
    label = "Efficacité mémoire moyenne"
    cases = [(10.0, "#ff0000"), (30.0, "#d4a500"), (70.0, "#ffa500"), (85.0, "#008000"),
             (200.0, "#ff0000"), (0.0, "#ff0000"), (20.0, "#ff0000"), (20.5, None), (21.0, "#d4a500"),
             (100.0, "#008000"), (100.5, None), (110.0, "#ffa500"), (150.0, "#ff0000"), (-5.0, "#ff0000"),
             (float("nan"), None), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in cases], f"`{label}` double").coalesce(1)
    assert values(columns.add_bands(df), f"{label}_band") == [c for _, c in cases]
    text_df = spark.createDataFrame([("not a number",)], "v string")
    assert values(text_df.select(numbers.efficiency_band(F.col("v"), label).alias("b")), "b") == [None]
    assert values(df.select(numbers.efficiency_band(F.lit(50), "Hauteur de neige").alias("b")), "b")[0] is None
    for name in numbers.BANDED_LABELS:
        got = spark.range(1).select(numbers.efficiency_band(F.lit(85.0), name).alias("b")).first().b
        assert got == "#008000", name


def test_durations(spark):
    cases = [("3661", "1h 1m 1s"), ("61.9", "1m 1s"), ("59", "59s"), ("0", "0s"), ("-1", "N/A"),
             ("text", "N/A"), (None, "N/A"), ("90000", "25h 0m 0s")]
    df = frame(spark, "v", [v for v, _ in cases])
    assert values(df.select(times.format_duration(F.col("v")).alias("d")), "d") == [d for _, d in cases]


def test_rounding(spark):
    # 1.005 scales to just under 100.5, where rounding its decimal text would go up.
    cases = [(2.675, 2.68), (1.005, 1.0), (0.125, 0.13), (-0.125, -0.13)]
    df = frame(spark, "v", [v for v, _ in cases], "double")
    got = values(df.select(numbers.round_half_away(F.col("v"), 2).alias("r")), "r")
    assert got == [r for _, r in cases]


def test_log_stamps(spark):
    lines = ["[Thu Mar  5 11:45:18 2026]", "x [Thu Mar 5 11:45:18 2026] y", "[Fri Mar  5 11:45:18 2026]",
             "[Thu Mar  5 24:45:18 2026]", "[Mon Feb 30 11:45:18 2026]", "] [Thu Mar  5 11:45:18 2026]",
             "no stamp", "[]", "[thu mar 05 11:45:18 2026]", "[Thu Arm  5 11:45:18 2026]"]
    line = F.col("line")
    date = F.when(times.has_log_stamp(line), times.day_date(times.stamp_day(line)))
    got = values(frame(spark, "line", lines).select(date.alias("d")), "d")
    day = "2026-03-05"
    assert [str(d) if d else None for d in got] == [day, day] + [None] * 6 + [day, None]


def test_project_dirs(spark):
    paths = ["/scratch/lichen/.snakemake/log/run.log", "/scratch/loose/notes.log", "/.snakemake/log/x.log",
             "/a/.snakemake/log/deeper/x.log"]
    df = frame(spark, "p", paths).select(text.project_dir(F.col("p")).alias("d"))
    assert values(df, "d") == ["/scratch/lichen", None, "/", None]
