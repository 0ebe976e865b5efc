"""Accounting clustered on the job, so that collapsing needs no shuffle.

Rows are dealt into buckets by ``JobRoot`` when they are written, and each row
gets its place among those of its job as one number. A job of very many rows
would make one bucket, and the task that reads it, as large as itself; such jobs
are kept apart, unbucketed, and are collapsed by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.allocations import row_order
from ..operators.columns import add_job_columns
from ..schema import PLACE_COLUMN
from ..session import in_parts, materialize, shuffles_removed

JOB = "JobRoot"
# Rows are shuffled and written in so many parts, one after the other.
PARTS = 4


@dataclass(frozen=True)
class ClusteredTable:
    """``jobs`` has a bucket for all rows of a job; ``crowded`` the rows of the jobs that were too large for that."""

    jobs: DataFrame
    crowded: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.jobs.columns

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> ClusteredTable:
        """Both parts changed row by row, which leaves them clustered."""
        return ClusteredTable(change(self.jobs), change(self.crowded))

    def where(self, condition: Column | str) -> ClusteredTable:
        return self.transform(lambda part: part.where(condition))

    def per_job(self, collapse: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``collapse`` makes of each job; no job is in both parts."""
        return collapse(self.jobs).unionByName(collapse(self.crowded))


def write_clustered_table(rows: DataFrame, name: str, path: str, buckets: int, most_rows: int = 1 << 20) -> None:
    """``rows`` as the bucketed table ``name`` under ``path``, and its crowded jobs as ``<name>_crowded``.

    ``rows`` are computed once and stored, dealt into parts of whole buckets; each part is then shuffled once,
    on the job, and written, so that not all rows are in a shuffle at once. Jobs of more than ``most_rows`` rows,
    those without an id among them, are crowded: their rows stay where they are. The place of
    a row among those of its job follows ``row_order``.
    """
    bucket = F.pmod(F.hash(JOB), F.lit(buckets))
    mode = "errorifexists"
    for jobs in in_parts(add_job_columns(rows), F.pmod(bucket, F.lit(PARTS))):
        # stored, as a list of known size is broadcast if it is small, and the rows then stay where they are
        crowds = jobs.groupBy(JOB).count().where(F.col("count") > most_rows).select(F.col(JOB).alias("_crowd"))
        counts = materialize(crowds)
        marked = jobs.join(counts, F.col(JOB).eqNullSafe(F.col("_crowd")), "left_semi")
        others = jobs.join(counts, F.col(JOB).eqNullSafe(F.col("_crowd")), "left_anti").repartition(buckets, JOB)
        order = row_order(others, [JOB]) or [F.lit(0)]
        texts = [F.col(f"`{c}`") for c, kind in others.dtypes if kind == "string" and c != JOB]  # rows without places may tie
        placed = others.withColumn(PLACE_COLUMN, F.row_number().over(Window.partitionBy(JOB).orderBy(*order, F.xxhash64(*texts))))
        bucketed = placed.write.mode(mode).option("path", f"{path.rstrip('/')}/jobs").bucketBy(buckets, JOB).sortBy(JOB, PLACE_COLUMN)
        with shuffles_removed(rows.sparkSession):
            bucketed.saveAsTable(name)
            marked.write.mode(mode).option("path", f"{path.rstrip('/')}/crowded").saveAsTable(f"{name}_crowded")
        mode = "append"


def scan_clustered_table(spark: SparkSession, name: str) -> ClusteredTable:
    return ClusteredTable(spark.table(name), spark.table(f"{name}_crowded"))


def drop_clustered_table(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_crowded"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
