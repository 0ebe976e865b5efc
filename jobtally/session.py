"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Settings the reports rely on or gain from; one that the cluster, the caller or
# the running session has set already stays as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}
_local_folders: dict[str, str] = {}


def get_session(app_name: str = "jobtally", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    loaded = spark._jsparkSession.sessionState().conf()
    for key, value in DEFAULTS.items():
        if not loaded.contains(key):
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which goes
    with the process; elsewhere a machine-local folder would be lost with its
    executor, so we refuse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_folders:
        made = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="jobtally-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _local_folders[context.applicationId]


# Whether what a query shuffled is removed when it ends; otherwise it stays until the driver collects garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes within it leave no shuffle files behind, unless the session says otherwise."""
    if spark.conf.get(REMOVE_SHUFFLES, None) is not None:
        yield
        return
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(REMOVE_SHUFFLES)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/jobtally-{uuid.uuid4()}"


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` as a table written once, for plans that read it several times.

    Later reads fetch only their columns, know the table's size, and do not go
    back to the source when an executor is lost. What ``df`` shuffled is removed
    then. The table stays in the folder of the cluster, which decides how long.
    """
    path = new_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _as_before(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` read back, with the records that ``schema`` says are never null known as such again."""
    records = [f for f in schema if isinstance(f.dataType, T.StructType) and not f.nullable]
    return df.withColumns(
        {f.name: F.struct(*[F.col(f"`{f.name}`.`{g}`").alias(g) for g in f.dataType.names]) for f in records}
    )


def in_parts(df: DataFrame, number: Column, most_bytes: int = 1 << 26) -> Iterator[DataFrame]:
    """``df`` stored once, dealt by ``number`` into a few parts, and handed out part by part.

    What shuffles a part and writes its result under :func:`shuffles_removed` has only that part's
    shuffle on disk. A part is removed when the next is asked for, so it must have been used by then.
    Parts of up to ``most_bytes`` together are handed out as one.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    with shuffles_removed(spark):
        df.withColumn("_part", number).write.partitionBy("_part").parquet(path, compression="zstd")
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rounds: list[list[str]] = []
    room = 0
    for status in system.globStatus(hadoop.Path(path, "_part=*")):
        part, size = status.getPath(), system.getContentSummary(status.getPath()).getLength()
        if not rounds or size > room:
            rounds.append([])
            room = most_bytes
        rounds[-1].append(part.toString())
        room -= size
    try:
        for folders in rounds or [[path]]:  # a table without rows has no parts
            yield _as_before(spark.read.schema(df.schema).parquet(*folders), df.schema)
            for folder in folders:
                system.delete(hadoop.Path(folder), True)
    finally:
        system.delete(hadoop.Path(path), True)
