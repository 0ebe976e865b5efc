"""The allocation and daily reports against plain Python on random accounting rows."""

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtally.plans.daily_report import daily_report
from jobtally.plans.generic import generic_report

COLUMNS = ["JobID", "JobName", "QOS", "State", "NodeList", "Submit", "Start", "End", "ElapsedRaw", "MaxRSS",
           "ReqMem", "TotalCPU", "CPUTimeRAW"]
TYPES = ", ".join(f"`{c}` {'bigint' if c.endswith(('Raw', 'RAW')) else 'string'}" for c in COLUMNS)


def random_rows(rng, jobs):
    def maybe(value, chance=0.6):
        return value if rng.random() < chance else None

    def moment():
        return (datetime(2026, 1, 14) + timedelta(seconds=rng.randrange(3 * 86400))).strftime("%Y-%m-%dT%H:%M:%S")

    rows = []
    for job in range(jobs):
        root = rng.choice([str(job), str(job), "777", "x"])
        for suffix in rng.sample(["", ".batch", ".extern", ".0", ".1", ".10", ".abc", "_3"], rng.randrange(1, 6)):
            rows.append({
                "JobID": root + suffix,
                "JobName": rng.choice(["a" * 36, "b" * 36, "batch", None]),
                "QOS": maybe(rng.choice(["normal", "long"])), "State": maybe(rng.choice(["FAILED", "COMPLETED", "PREEMPTED", "RUNNING"])),
                "NodeList": maybe(f"n{rng.randrange(5)}"), "Submit": maybe(moment()), "Start": maybe(moment()),
                "End": maybe(rng.choice([moment(), "Unknown"])), "ElapsedRaw": maybe(rng.randrange(5000)),
                "MaxRSS": maybe(rng.choice(["12K", "3000M", "1.5G", "2T", "0", "junk"])),
                "ReqMem": maybe(rng.choice(["4G", "500M", "0"])),
                "TotalCPU": maybe(rng.choice(["1-02:03:04", "02:03:04", "03:04.5", "03:04", "bad"])),
                "CPUTimeRAW": maybe(rng.randrange(3000)),
            })
    return rows


def size(text):
    found = re.search(r"([0-9]+)([KMGT])", text or "")
    return int(found[1]) * 1024 ** (1 + "KMGT".index(found[2])) if found else 0


def cpu(text):
    text = text or ""
    if m := re.fullmatch(r"(\d+)-(\d+):(\d+):(\d+)", text):
        return int(m[1]) * 86400 + int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4])
    if m := re.fullmatch(r"(\d+):(\d+):(\d+)", text):
        return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])
    if m := re.fullmatch(r"(\d+):(\d+)\.\d+", text):
        return int(m[1]) * 60 + int(m[2])
    return 0


def place(row):
    suffix = re.match(r"^\d+\.(.+)$", row["JobID"])
    kind = suffix[1] if suffix else ""
    if kind.isdigit():
        return (3, int(kind), row["at"])
    return ({"": 0, "batch": 1, "extern": 2}.get(kind, 4), -1, row["at"])


def collapse(rows):
    groups = {}
    for row in rows:
        root = re.match(r"^\d+", row["JobID"])
        groups.setdefault(root[0] if root else None, []).append(row)
    result = {}
    for root, members in groups.items():
        members.sort(key=place)

        def first(name, wanted=lambda v: v is not None):
            return next((m[name] for m in members if wanted(m[name])), None)

        def largest(values):
            return max((v for v in values if v is not None), default=None)

        result[root] = {
            **{c: first(c) for c in ("JobID", "QOS", "State", "NodeList", "Submit", "Start", "End")},
            "JobName": first("JobName", lambda v: v is not None and len(v) == 36),
            "ElapsedRaw": largest(m["ElapsedRaw"] for m in members),
            "CPUTimeRAW": largest(m["CPUTimeRAW"] for m in members),
            "MaxRSS": max(size(m["MaxRSS"]) for m in members), "ReqMem": max(size(m["ReqMem"]) for m in members),
            "TotalCPU_seconds": cpu(first("TotalCPU")),
        }
    return result


def moment_of(text):
    return datetime.fromisoformat(text) if text and text != "Unknown" else None


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    rng = random.Random(request.param)
    rows = random_rows(rng, 400)
    for at, row in enumerate(rows):
        row["at"] = at
    df = spark.createDataFrame([[r[c] for c in COLUMNS] + [r["at"]] for r in rows], TYPES + ", at bigint")
    source = F.struct(F.lit("dump").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("at").alias("row"))
    return rows, df.withColumn("_src", source).drop("at").repartition(7, F.rand(request.param))


def test_allocations(case):
    rows, df = case
    wanted = collapse(rows)
    got = {r.JobRoot: r for r in generic_report(df).collect()}
    assert set(got) == set(wanted)
    for root, row in wanted.items():
        assert {c: got[root][c] for c in row} == row, root


def test_daily(case):
    rows, df = case
    wanted = collapse(rows)
    daily = {
        (r.scope, r.QOS): r
        for r in daily_report(df, day="2026-01-15").collect()
    }
    groups = {("global", None): list(wanted.values())}
    for row in wanted.values():
        groups.setdefault(("qos", row["QOS"]), []).append(row)
    assert set(daily) == set(groups)
    day = datetime(2026, 1, 15).date()
    for key, jobs in groups.items():
        got = daily[key]
        times = [(moment_of(j["Submit"]), moment_of(j["Start"]), moment_of(j["End"])) for j in jobs]
        waits = [int((s - b).total_seconds()) for b, s, _ in times if b and s]
        lengths = [(e - s).total_seconds() for _, s, e in times if s and e]
        assert got.cpu_seconds == sum(j["TotalCPU_seconds"] for j in jobs)
        assert got.gb_seconds == pytest.approx(sum(j["MaxRSS"] / 2**30 * j["ElapsedRaw"] for j in jobs if j["ElapsedRaw"] is not None))
        assert got.ram_percent == pytest.approx(
            sum(j["MaxRSS"] // 2**30 * j["ElapsedRaw"] for j in jobs if j["ElapsedRaw"] is not None) / 188611200 * 100
        )
        for i, name in enumerate(("submitted", "started", "ended")):
            assert got[name] == sum(1 for t in times if t[i] and t[i].date() == day)
        for name, state in (("succeeded", "COMPLETED"), ("failed", "FAILED"), ("preempted", "PREEMPTED")):
            assert got[name] == sum(j["State"] == state for j in jobs)
        if waits:
            assert (got.wait_median, got.wait_min, got.wait_max) == (statistics.median(waits), min(waits), max(waits))
            assert got.wait_mean == pytest.approx(statistics.mean(waits))
        if lengths:
            assert (got.duration_median, got.duration_max) == (statistics.median(lengths), max(lengths))
