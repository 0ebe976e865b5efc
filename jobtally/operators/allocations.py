"""One row per allocation from the rows of its batch, extern and step records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import numbers
from ..schema import PLACE_COLUMN, SOURCE_COLUMN

RUN_ID_LENGTH = 36


# Kinds of rows in the order dumps list them.
ROW_KINDS = ["allocation", "batch", "extern", "step", "unknown"]


def row_order(df: DataFrame, keys: list[str]) -> list[Column]:
    """What makes one row of an allocation come before another.

    Day, then allocation, batch, extern, numbered steps, others, then the place
    in the source; the parts ``df`` lacks or groups by are left out. All parts
    are numbers, as every text column's aggregate carries a copy of them: files
    are told apart by a hash, since dumps have no order among themselves.
    """
    order = []
    if "date" in df.columns and "date" not in keys:
        order.append(F.col("date"))
    if "JobInfoType" in df.columns:
        kind = F.col("JobInfoType")
        number = F.substring_index("JobID", ".", -1).try_cast("bigint")
        order.append(F.array_position(F.array(*[F.lit(k) for k in ROW_KINDS]), kind))
        order.append(F.when(kind == "step", number))
    if SOURCE_COLUMN in df.columns:
        place = F.col(SOURCE_COLUMN)
        order += [F.xxhash64(place["file"]), place["block"], place["row"]]
    return order


def first_non_null(
    c: Column, place: Column, shared: Column | None = None, condition: Column | None = None
) -> Column:
    """First value of ``c`` that is not null, by ``place``.

    Equal places are told apart by the value, so the result never depends on the
    order of arrival. ``shared`` says which rows may share their place, if only some do.
    """
    wanted = c.isNotNull() if condition is None else condition
    tie = c if shared is None else F.when(shared, c)
    return F.min_by(c, F.when(wanted, F.struct(place, tie)))


def aggregate_per_alloc(
    df: DataFrame,
    group_by: str | list[str] = "JobRoot",
    order_by: list[Column] | None = None,
) -> DataFrame:
    """Collapse the rows of each group: largest number, first non-null of all else.

    ``JobName`` keeps its first value of run-id length. ``min_by`` with an
    explicit order is partially aggregated before the one shuffle, so a group of
    any size leaves each map task as a single row, and its result does not
    depend on the order rows arrive in. Aggregates nobody reads are pruned.

    Rows of a clustered table have their place in the job as one number, and
    need no shuffle where they lie by job.
    """
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    numbered = order_by is None and PLACE_COLUMN in df.columns and "JobRoot" in keys
    # where the schema says that every row has a place, none can share it and the place alone is the order
    placed = order_by is None and SOURCE_COLUMN in df.columns and not df.schema[SOURCE_COLUMN].nullable
    # rows merged from a source without places have none, and only those may share theirs
    may_share = order_by is None and not numbered and not placed and SOURCE_COLUMN in df.columns
    shared = F.col("_placeless") if may_share else None
    ordered, place = df, F.col(PLACE_COLUMN)
    if not numbered:
        # Built once per row; every min_by then shares it.
        ordered, place = df.withColumn("_place", F.struct(*(order_by or row_order(df, keys) or [F.lit(0)]))), F.col("_place")
    if shared is not None:
        ordered = ordered.withColumn("_placeless", F.col(SOURCE_COLUMN).isNull())

    def first(c: Column, condition: Column | None = None) -> Column:
        if numbered or placed:
            return F.min_by(c, F.when(c.isNotNull() if condition is None else condition, place))
        return first_non_null(c, place, shared, condition)

    aggregates = []
    for field in df.schema:
        name = field.name
        if name in keys or name in (SOURCE_COLUMN, PLACE_COLUMN):
            continue
        c = F.col(f"`{name}`")
        if name == "JobName":
            value = first(c, F.length(c) == RUN_ID_LENGTH)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = numbers.max_skipping_nan(c)
        elif isinstance(field.dataType, T.NumericType):
            value = F.max(c)
        else:
            value = first(c)
        aggregates.append(value.alias(name))
    # Rows are sorted to be collapsed. Sorting compares some bytes of the first key and turns to whole rows
    # where these are equal: so the job comes first, as a day is the same in very many rows.
    telling_first = sorted(keys, key=lambda k: k != "JobRoot")
    collapsed = ordered.groupBy(*[F.col(f"`{k}`") for k in telling_first]).agg(*aggregates)
    return collapsed.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`") for c in collapsed.columns[len(keys):]])
