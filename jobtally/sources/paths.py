"""Questions about files that Spark's readers do not answer by themselves."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, SparkSession, functions as F


def matching_paths(spark: SparkSession, path: str) -> list[str]:
    """The path itself if it exists, or what it matches as a file-system pattern (``*?[]{}``)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not set(path) & set("*?[{"):
        return [path] if file_system.exists(hadoop_path) else []
    return [status.getPath().toString() for status in file_system.globStatus(hadoop_path) or []]


def existing_paths(spark: SparkSession, paths: list[str], at_once: int = 16) -> list[str]:
    """What there is of ``paths``, in their order; the file system is asked about ``at_once`` of them at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        found = pool.map(lambda path: matching_paths(spark, path), paths)
        return list(dict.fromkeys(path for part in found for path in part))


def plain_path(uri: Column) -> Column:
    """Path of a scanned file without the ``file:`` scheme and percent escapes."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:(//)?(?=/)", "")
