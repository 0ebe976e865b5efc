"""Columns of results in a form that compares exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers


def r6(c: Column | str) -> Column:
    return numbers.round_half_away(F.col(c) if isinstance(c, str) else c, 6)


def day_text(c: str = "date") -> Column:
    return F.col(c).cast("string").alias(c)


def finite_parts(name: str) -> list[Column]:
    """``name`` where finite, else null, and what kind of value it is."""
    c = F.col(name)
    c = c.cast("double")
    kind = (
        F.when(c.isNull(), "null")
        .when(F.isnan(c), "nan")
        .when(F.abs(c) == float("inf"), "inf")
        .otherwise("finite")
    )
    return [r6(F.when(kind == "finite", c)).alias(name), kind.alias(f"{name}_kind")]


def with_kinds(df: DataFrame) -> DataFrame:
    """Every double column of ``df`` as its finite value and its kind."""
    parts = [finite_parts(c) if kind == "double" else [F.col(c)] for c, kind in df.dtypes]
    return df.select(*[c for part in parts for c in part])
