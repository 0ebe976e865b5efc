"""Writing tables and documents."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, DataFrameWriter

from ..operators.documents import daily_documents
from ..operators.tables import union_by_name


def _replacing_days(df: DataFrame) -> DataFrameWriter:
    """A writer that empties the dates ``df`` holds and leaves the others alone."""
    replacing = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return replacing.partitionBy("date")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_accounting_table(df: DataFrame, path: str, replace_days: bool = False) -> None:
    """Accounting rows partitioned by ``date``, added to what is there.

    ``replace_days`` first empties the dates that ``df`` holds, so that a dump can
    be written again. Rebalancing gives each date few files of fair size: small
    dates are merged and a huge date is written by several tasks.
    """
    even = df.hint("rebalance", "date")
    writer = (
        _replacing_days(even) if replace_days else even.write.mode("append").partitionBy("date")
    )
    writer.parquet(path)


def write_day_files(df: DataFrame, folder: str) -> None:
    """Rows as one loose ``<date>.parquet`` for each ``date`` of ``df``, in one job however many days there are.

    A day already there is replaced. Each is a folder of few files, as Spark
    writes it: days come out together in a folder beside and are then renamed.
    """
    spark, target = df.sparkSession, folder.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    made = hadoop.Path(f"{target}/_days-{uuid.uuid4()}")
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    df.hint("rebalance", "date").write.partitionBy("date").parquet(made.toString())

    def settle(status: JavaObject) -> None:
        day = status.getPath().getName().removeprefix("date=")
        place = hadoop.Path(f"{target}/{day}.parquet")
        system.delete(place, True)
        if not system.rename(status.getPath(), place):
            raise OSError(f"cannot move {status.getPath()} to {place}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(settle, system.globStatus(hadoop.Path(made, "date=*"))))
    system.delete(made, True)


def write_merged_parquet(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    write_parquet(union_by_name(frames), path, mode)


def write_input_sizes(sizes: DataFrame, path: str, mode: str = "append") -> None:
    sizes.write.mode(mode).options(sep="|", header=True).csv(path)


def write_daily_json(metrics: DataFrame, folder: str) -> None:
    """One JSON document per day under ``date=<date>`` folders; a day written again is replaced.

    Making a file takes far longer than its few bytes, so days are dealt to as many tasks as the
    session shuffles to; without the number one or two tasks would make all files one after the other.
    """
    parts = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _replacing_days(daily_documents(metrics.repartition(parts, "date"))).text(folder)


def write_daily_rows(metrics: DataFrame, folder: str) -> None:
    """The daily table itself as JSON lines by date, for readers that want rows."""
    _replacing_days(metrics).option("ignoreNullFields", False).json(folder)
