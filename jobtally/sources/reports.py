"""Reading back daily report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.documents import document_metrics
from ..operators.period import in_period
from .paths import plain_path

DOCUMENT_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\.json\z|/[^/]*\z)"


def read_daily_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(date, document)`` from ``<date>.json`` files or ``date=<date>`` folders.

    A file is one day's document, whose size is that of its QOS classes' metrics.
    """
    documents = (
        spark.read.option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
        .select(
            F.regexp_extract(plain_path(F.col("_metadata.file_path")), DOCUMENT_DATE, 1)
            .try_cast("date")
            .alias("date"),
            F.col("value").alias("document"),
        )
    )
    return documents.where(F.col("date").isNotNull() & (F.length(F.trim("document")) > 0))


def scan_daily_json(spark: SparkSession, folder: str, from_date: str, to_date: str) -> DataFrame:
    """Overall metrics of each reported day of the range; no day at all is an error."""
    documents = read_daily_documents(spark, folder).transform(in_period, from_date, to_date)
    days = document_metrics(documents)
    if days.isEmpty():
        raise LookupError(f"no daily report in {folder} from {from_date} to {to_date}")
    return days
