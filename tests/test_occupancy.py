"""Daily totals from changes against one row per job and day."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtally.operators import columns, occupancy

SCHEMA = "Submit string, Start string, End string, QOS string, cpus int"


def random_jobs(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = datetime(2031, 3, 1) + timedelta(seconds=rng.randrange(60 * 86400))
        if rng.random() < 0.2:
            start = start.replace(hour=0, minute=0, second=0)
        end = start + timedelta(seconds=rng.choice([0, 30, 5000, 86399, 86400, 200000, 400 * 86400]) - rng.choice([0, 0, 900]))
        if rng.random() < 0.2:
            end = end.replace(hour=23, minute=59, second=59)
        texts = [t.isoformat() if rng.random() > 0.05 else "Unknown" for t in (start, end)]
        rows.append((None, *texts, rng.choice(["a", "b", None]), rng.choice([1, 4, 96, None])))
    return spark.createDataFrame(rows, SCHEMA)


def exploded(jobs, keys, weight):
    hours = F.col("daily_duration_hours") * weight
    totals = columns.explode_job_days(jobs).groupBy(*keys, "date").agg(F.count("*").alias("n"), F.sum(hours).alias("h"))
    return {tuple(r[k] for k in [*keys, "date"]): (r.n, pytest.approx(r.h, abs=1e-6)) for r in totals.collect()}


@pytest.mark.parametrize("keys", [["QOS"], []])
def test_totals_are_those_of_the_calendar(spark, keys):
    jobs = random_jobs(spark, 3)
    for weight in (None, F.col("cpus")):
        days = occupancy.daily_occupancy(jobs, keys, weight).collect()
        found = {tuple(r[k] for k in [*keys, "date"]): (r.running_jobs, r.hours) for r in days}
        assert len(found) == len(days) > 400
        assert found == exploded(jobs, keys, F.lit(1) if weight is None else F.coalesce(weight, F.lit(0)))


def test_changes_of_parts_merge(spark):
    """Changes kept from earlier dumps and those of a late one give the days of all jobs."""
    early, late = random_jobs(spark, 5, 200), random_jobs(spark, 6, 50)
    parts = [occupancy.job_changes(df, ["QOS"]) for df in (early, late)]
    merged = occupancy.occupied_days(occupancy.merge_changes(parts, ["QOS"]), ["QOS"])
    whole = occupancy.daily_occupancy(early.unionByName(late), ["QOS"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_rows_shuffled_do_not_grow_with_the_length_of_jobs(spark):
    jobs = spark.createDataFrame([(None, "2031-01-01T10:00:00", "2034-01-01T10:00:00", "a", 1)] * 50, SCHEMA)
    changes = occupancy.job_changes(jobs, ["QOS"])
    assert changes.count() == 4
    days = occupancy.occupied_days(changes, ["QOS"])
    assert days.count() == 1097 and days.agg(F.max("hours")).first()[0] == 1200.0


def test_no_jobs(spark):
    assert occupancy.daily_occupancy(spark.createDataFrame([], SCHEMA), ["QOS"]).count() == 0
