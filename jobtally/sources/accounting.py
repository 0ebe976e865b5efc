"""Reading accounting tables: typed dumps, raw dump lines, Parquet by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.tables import SEPARATOR, split_fields
from ..schema import ACCOUNTING_COLUMNS, ACCOUNTING_SCHEMA, SOURCE_COLUMN
from .paths import existing_paths, plain_path

FILE_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"


def read_accounting_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Dump with a header line and well-formed rows; a bad integer is an error."""
    return (
        spark.read.schema(ACCOUNTING_SCHEMA)
        .options(sep=SEPARATOR, header=True, quote="", mode="FAILFAST")
        .csv(path)
    )


def read_dump_lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Lines of dumps as text, with their place: ``(line, _src, file_name)``."""
    lines = spark.read.options(lineSep="\n", **options).text(path)
    return lines.select(
        F.regexp_replace("value", r"\r\z", "").alias("line"),
        F.struct(
            plain_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(SOURCE_COLUMN),
        F.col("_metadata.file_name").alias("file_name"),
    )


def _typed(fields: Column, reject: bool) -> list[Column]:
    columns = []
    for i, field in enumerate(ACCOUNTING_SCHEMA):
        value = F.when(fields[i] != "", fields[i])
        if field.dataType.simpleString() != "string":
            value = value.try_cast(field.dataType) if reject else value.cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


def _body(lines: DataFrame) -> DataFrame:
    """Lines that are not a header, split once into ``_fields``."""
    header = SEPARATOR.join(ACCOUNTING_COLUMNS)
    rows = lines.where(F.col("line") != header)
    return rows.withColumn("_fields", split_fields(F.col("line")))


def parse_dump_lines(lines: DataFrame, reject: bool = False) -> DataFrame:
    """Typed accounting rows of well-formed lines; header lines are left out.

    Quotes mean nothing and an empty field is null. A bad integer is an error,
    or null with ``reject``.
    """
    extra = [F.col(c) for c in lines.columns if c != "line"]
    return _body(lines).select(*_typed(F.col("_fields"), reject), *extra)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Well-formed lines with a field that is no integer where one belongs."""
    integers = [i for i, f in enumerate(ACCOUNTING_SCHEMA) if f.dataType.simpleString() == "bigint"]
    bad = F.filter(
        "_fields",
        lambda v, i: i.isin(integers) & (v != "") & v.try_cast("bigint").isNull(),
    )
    return _body(lines).where(F.size(bad) > 0).drop("_fields")


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def _with_source(df: DataFrame) -> DataFrame:
    if SOURCE_COLUMN in df.columns:
        return df
    place = F.struct(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("_metadata.row_index").alias("row"),
    )
    return df.select("*", place.alias(SOURCE_COLUMN))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Accounting table partitioned by ``date``, with the place of each row."""
    return _with_source(spark.read.parquet(path))


def scan_table_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of a partitioned table; an error when it has no such day."""
    rows = scan_table(spark, path).where(F.col("date") == F.lit(day).cast("date"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no rows dated {day} in {path}")
    return rows


def scan_day_files(spark: SparkSession, folder: str, days: list[str]) -> DataFrame:
    """Loose ``<date>.parquet`` files of ``days`` as one table with ``date``.

    Files that do not exist are passed over; none at all is an error. One scan
    reads them all in the accounting schema, so a column a file lacks is null.
    """
    wanted = [f"{folder.rstrip('/')}/{d}.parquet" for d in sorted(set(days))]
    paths = existing_paths(spark, wanted)
    if not paths:
        raise FileNotFoundError(f"no daily file in {folder} for {len(wanted)} dates")
    rows = _with_source(spark.read.schema(ACCOUNTING_SCHEMA).parquet(*paths))
    day = F.regexp_extract(F.col(f"{SOURCE_COLUMN}.file"), FILE_DATE + r"\.parquet(?:/[^/]*)?\z", 1)
    return rows.withColumn("date", day.try_cast("date"))


def scan_day(spark: SparkSession, folder: str, day: str) -> DataFrame:
    return scan_day_files(spark, folder, [day])
