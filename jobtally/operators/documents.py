"""JSON documents made of small report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .daily import METRIC_LABELS

GLOBAL_KEY = "global"


def columnar_json(df: DataFrame, order_by: list[str], most_rows: int = 1_000_000) -> DataFrame:
    """``{column: [values]}`` of a report table as one JSON text, nulls kept.

    For tables whose rows are rules, classes or days: the document is one value,
    so more than ``most_rows`` rows are an error, found before they are gathered.
    """
    count = df.limit(most_rows + 1).count()
    if count > most_rows:
        raise ValueError(f"a document of over {most_rows} rows")
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string")
    shown = [
        F.col(f"`{name}`") if kind in plain else F.col(f"`{name}`").cast("string").alias(name)
        for name, kind in df.dtypes
    ]
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    rows = df.select(order.alias("_order"), F.struct(*shown).alias("_row"))
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("_order", "_row"))).alias("_rows"))
    columns = [F.col("_rows._row").getField(name).alias(name) for name in df.columns]
    return gathered.select(
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document")
    )


def daily_documents(metrics: DataFrame) -> DataFrame:
    """``(date, document)``: the day's metrics per QOS and overall as nested JSON.

    A missing QOS gets the key ``""``. A QOS called ``global`` would hide the
    overall metrics, so it is an error. A document holds one entry per QOS.
    """
    is_global = F.col("scope") == "global"
    clash = ~is_global & (F.col("QOS") == GLOBAL_KEY)
    key = (
        F.when(clash, F.raise_error(F.lit("a QOS is called 'global'")).cast("string"))
        .when(is_global, GLOBAL_KEY)
        .otherwise(F.coalesce("QOS", F.lit("")))
    )
    values = F.struct(*[F.col(c).alias(label) for c, label in METRIC_LABELS.items()])
    entries = metrics.select("date", key.alias("key"), values.alias("value"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return entries.groupBy("date").agg(
        F.to_json(whole, {"ignoreNullFields": "false"}).alias("document")
    )


def document_metrics(documents: DataFrame) -> DataFrame:
    """The overall metrics of each daily document: ``(date, metrics)``.

    Days without a ``global`` entry are left out; one that is not an object
    counts as a day without metrics. Values that are not numbers are left out.
    """
    top = F.from_json("document", "map<string,string>")
    opened = documents.select("date", top.alias("top")).where(
        F.map_contains_key("top", F.lit(GLOBAL_KEY))
    )
    entry = F.col("top")[GLOBAL_KEY]
    fields = F.from_json(F.when(entry.startswith("{"), entry), "map<string,string>")
    numbers = F.map_filter(
        F.transform_values(fields, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull()
    )
    return opened.select(
        "date", F.coalesce(numbers, F.create_map().cast("map<string,double>")).alias("metrics")
    )
