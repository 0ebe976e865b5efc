"""Input files of workflow jobs: their sizes, and the join to allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from .columns import add_size_relative

# Keys that cannot match are spread over this many negative stand-ins.
SPREAD = 1 << 20


def resolve_inputs(records: DataFrame) -> DataFrame:
    """Total input size and input paths of each log record that was submitted.

    ``records`` carries ``log_path``, ``record_no``, the ids, ``inputs`` and
    ``project_dir``. Adds ``path`` (as used for the lookup) one row per input.
    """
    submitted = records.where(F.col("job_id") != "")
    exploded = submitted.select(
        "log_path",
        "record_no",
        "slurm_jobid",
        "job_id",
        "rule_name",
        "project_dir",
        F.posexplode_outer("inputs").alias("pos", "written_path"),
    )
    absolute = F.col("written_path").startswith("/") | F.col("project_dir").isNull()
    path = F.when(absolute, F.col("written_path")).otherwise(
        text.join_path(F.col("project_dir"), F.col("written_path"))
    )
    return exploded.withColumn("path", F.nullif(path, F.lit("")))


def _lookup_key(path: Column) -> Column:
    """``path``, or for a missing one a text no path equals, spread over many values."""
    spread = F.pmod(F.xxhash64("log_path", "record_no"), F.lit(SPREAD)).cast("string")
    return F.coalesce(path, F.concat(F.lit("\0"), spread))


def input_sizes(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Size table: one row per submitted record, files not in ``manifest`` count 0.

    The join to the manifest is a plain equality on the path: Spark broadcasts a
    small manifest, and AQE cuts the partition of a path that very many records
    name. Only a record's own path list is ever gathered in one place.
    """
    wanted = resolve_inputs(records).withColumn("_key", _lookup_key(F.col("path")))
    sizes = manifest.select(F.col("path").alias("_file"), "length")
    looked_up = wanted.join(sizes, F.col("_key") == F.col("_file"), "left")
    # A found file is listed by its full path, a missing one as the log wrote it.
    shown = F.when(F.col("length").isNotNull(), F.col("path")).otherwise(F.col("written_path"))
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", shown.alias("path")))
    listed = F.array_sort(F.collect_list(entry))
    return (
        looked_up.groupBy("log_path", "record_no", "slurm_jobid", "job_id", "rule_name")
        .agg(
            F.coalesce(F.sum("length"), F.lit(0)).alias("input_size_bytes"),
            F.array_join(F.transform(listed, lambda x: x["path"]), ",").alias("inputs"),
        )
        .select("slurm_jobid", "job_id", "rule_name", "input_size_bytes", "inputs")
    )


def enrich_with_input_sizes(
    allocations: DataFrame, sizes: DataFrame, used_memory: bool = False
) -> DataFrame:
    """Allocations left-joined to input sizes on the job id, with relative metrics.

    Ids that are not numbers match nothing; they get distinct negative join keys
    so that they do not all meet in one shuffle partition. Several size rows of a
    job give several rows.
    """
    number = F.col("JobID").try_cast("bigint")
    stand_in = F.lit(-1) - F.pmod(F.xxhash64("JobID", "JobRoot"), F.lit(SPREAD))
    left = allocations.withColumn("_join_id", F.coalesce(number, stand_in))
    right = sizes.select(
        F.col("slurm_jobid").try_cast("bigint").alias("_size_id"), "input_size_bytes", "inputs"
    ).where(F.col("_size_id") >= 0)
    joined = left.join(right, F.col("_join_id") == F.col("_size_id"), "left")
    enriched = joined.drop("_join_id", "_size_id").transform(add_size_relative, used_memory)
    relative = ["MinPerMo", "UsedRAMPerMo"] + (["MaxRSSPerMo"] if used_memory else [])
    return enriched.select(
        *[F.col(f"`{c}`") for c in allocations.columns], *relative, "input_size_bytes", "inputs"
    )
