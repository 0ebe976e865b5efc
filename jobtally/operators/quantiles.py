"""Exact quantiles of groups of any size, by counted narrowing.

Each value has an order-preserving whole number of 64 bits. A pass over the rows
counts, for every group and column, how many numbers share their leading bits,
and keeps the least and the most of these values; the counts tell which leading
bits each wanted rank has, and how many values share them. Passes add bits for
the ranks whose values are still many and not all the same, then a last pass
counts the few values that lie in a wanted rank's bracket. Nothing is estimated,
so nothing can be missed, and groups of all sizes take the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

# Leading bits that a pass adds, so that a histogram has at most 65,536 rows per group and column.
BITS = 16
# Values of a rank's bracket that the last pass may gather.
MOST_VALUES = 1 << 16
SALTS = 32

_MANTISSA = 1 << 52
_INFINITY = 2047 * _MANTISSA
_LEAST_EXPONENT = -1022


@dataclass(frozen=True)
class Quantile:
    name: str
    column: str
    fraction: float


def order_key(v: Column, step: Callable[[str, Column], Column] = lambda name, c: c) -> Column:
    """A double as a whole number of the same order; equal only for equal values. NaN comes last, and -0 is 0.

    ``step`` may keep what is used more than once.
    """
    two = F.lit(2.0)
    size = step("_size", F.when(F.abs(v) < float("inf"), F.abs(v)))  # null for NaN too, which is more than infinity
    guess = step("_guess", F.floor(F.log2(size)))
    power = step("_power", F.pow(two, guess.cast("double")))
    # the logarithm may be rounded over a power of two
    exponent = step("_exponent", guess - F.when(size < power, 1).otherwise(0) + F.when(size >= power * two, 1).otherwise(0))
    normal = exponent >= _LEAST_EXPONENT
    scaled = step("_scaled", size / F.pow(two, F.greatest(exponent, F.lit(_LEAST_EXPONENT)).cast("double")))
    above = F.when(normal, exponent - (_LEAST_EXPONENT - 1)).otherwise(0) * F.lit(_MANTISSA)
    bits = above + ((scaled - F.when(normal, 1.0).otherwise(0.0)) * F.lit(float(_MANTISSA))).cast("bigint")
    key = step("_key", F.when(v == 0, F.lit(0)).when(F.abs(v) >= float("inf"), F.lit(_INFINITY)).otherwise(bits))
    return F.when(F.isnan(v), F.lit(_INFINITY + 1)).otherwise(F.when(v < 0, -key).otherwise(key))


def with_order_key(df: DataFrame) -> DataFrame:
    """``df`` with the ``key`` of its ``v``, a step at a time: each is computed once, by short code."""

    def kept(name: str, c: Column) -> Column:
        nonlocal df
        df = df.withColumn(name, c)
        return F.col(name)

    key = order_key(F.col("v"), kept)
    return df.withColumn("key", key)


def attach_group_rows(
    rows: DataFrame, groups: DataFrame, keys: list[str], spread_by: list[str], salts: int = SALTS
) -> DataFrame:
    """Add the columns of ``groups``, one row per key, to every row of its group.

    Spark broadcasts ``groups`` when its size allows. Otherwise both sides are
    shuffled on the keys and a salt taken from ``spread_by``, which cuts a hot
    group into ``salts`` parts (and AQE may cut further).
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = groups.select(
        *[F.col(f"`{k}`").alias(f"_key_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in groups.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_group_salt"),
    )
    on = F.col("_salt") == F.col("_group_salt")
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`"))
    joined = left.join(right, on, "inner")
    return joined.drop("_salt", "_group_salt", *[f"_key_{k}" for k in keys])


def _shift(key: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", key, by if isinstance(by, Column) else F.lit(by))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[f"`{k}`"].eqNullSafe(right[f"`{k}`"])
    return on


def _value(name: str) -> Column:
    """A column as a double, and -0 as 0."""
    v = F.col(f"`{name}`").cast("double")
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def _entries(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each value: its group, the number of its column, the value."""
    values = F.array(*[F.struct(F.lit(i).alias("at"), _value(c).alias("v")) for i, c in enumerate(columns)])
    return rows.select(*[F.col(f"`{k}`") for k in keys], F.inline(values))


def _counted(entries: DataFrame, within: list[Column], shift: int) -> DataFrame:
    """How many values share their leading bits, and the least and the most of them."""
    keyed = with_order_key(entries)
    return keyed.groupBy(*within, _shift(F.col("key"), shift).alias("bits")).agg(F.count("*").alias("inside"), F.min("v").alias("least"), F.max("v").alias("most"))


def _narrowed(counts: DataFrame, within: list[Column], by: str = "bits") -> DataFrame:
    """Of ``counts``, which have the ``ranks`` wanted of their bracket and the rows ``below`` it, those a rank falls in."""
    before = F.col("below") + F.sum("inside").over(Window.partitionBy(*within).orderBy(by)) - F.col("inside")
    ranked = counts.withColumn("below", before)
    hit = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("inside")))
    return ranked.withColumn("ranks", hit).where(F.size("ranks") > 0)


def _slotted(brackets: DataFrame, group: list[Column]) -> DataFrame:
    """``brackets`` numbered within their group and column."""
    place = Window.partitionBy(*group, "at").orderBy("least")  # brackets are disjoint
    return brackets.withColumn("slot", F.row_number().over(place) - 1)


def _entries_within(
    rows: DataFrame, brackets: DataFrame, keys: list[str], columns: list[str], slots: list[int], spread_by: list[str]
) -> DataFrame:
    """The values that lie in a bracket, and its ``slot``; ``slots`` says how many a column may have.

    Values are compared with the least and the most of each bracket, which are columns of their own,
    a column of ``rows`` at a time: that is code short enough to be compiled.
    """
    parts = []
    for i, c in enumerate(columns):
        mine = brackets.where(F.col("at") == i).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
            *[F.max(F.when(F.col("slot") == j, F.col(end))).alias(f"_{end}_{j}") for j in range(slots[i]) for end in ("least", "most")]
        )
        names = dict.fromkeys([*keys, *spread_by])
        values = rows.select(*[F.col(f"`{k}`") for k in names], _value(c).alias("v"))
        inside = [(F.col("v") >= F.col(f"_least_{j}")) & (F.col("v") <= F.col(f"_most_{j}")) for j in range(slots[i])]
        found = attach_group_rows(values, mine, keys, spread_by).select(
            *[F.col(f"`{k}`") for k in keys], F.lit(i).alias("at"), "v", F.coalesce(*[F.when(x, F.lit(j)) for j, x in enumerate(inside)]).alias("slot")
        )
        parts.append(found.where(F.col("slot").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def _ranks(quantiles: list[Quantile], columns: list[str]) -> Column:
    """The ranks that the quantiles of column ``at`` need among ``n`` values; two for one that lies between."""
    fractions = F.array(*[F.array(*[F.lit(float(q.fraction)) for q in quantiles if q.column == c]) for c in columns])
    places = F.transform(F.get(fractions, F.col("at")), lambda f: (F.col("n") - 1) * f)
    return F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))))


def exact_quantiles(
    rows: DataFrame, keys: list[str], quantiles: list[Quantile], spread_by: list[str],
    bits: int = BITS, most_values: int = MOST_VALUES,
) -> DataFrame:
    """Exact quantiles of ``rows`` per group of ``keys``, interpolated linearly; a row for each group.

    Reads ``rows`` twice, and once more for each further ``bits`` that a rank
    needs: hand it a stored table. A group without values gets nulls. NaN ranks last.

    Shuffles carry counts, and at most ``most_values`` distinct values of a wanted
    rank, whatever a group's size; a value that fills a bracket alone is not looked for again.
    """
    columns = list(dict.fromkeys(q.column for q in quantiles))
    slots = [2 * sum(q.column == c for q in quantiles) for c in columns]
    names = dict.fromkeys([*keys, *spread_by, *columns])
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    group = [F.col(f"`{k}`") for k in keys]
    place = [*group, F.col("at"), F.col("slot")]
    shift = 64 - bits
    counts = materialize(_counted(_entries(rows, keys, columns), [*group, F.col("at")], shift))
    groups, known = counts, counts.where(F.col("bits").isNotNull())
    known = known.withColumn("n", F.sum("inside").over(Window.partitionBy(*group, "at")))
    wanted = known.withColumn("ranks", _ranks(quantiles, columns)).withColumn("below", F.lit(0).cast("bigint"))
    first = _narrowed(wanted, [*group, F.col("at")])
    state = materialize(_slotted(first.withColumn("shift", F.lit(shift)), group))

    def within(parents: DataFrame, counted: DataFrame) -> DataFrame:
        """``counted`` next to what is known of the brackets that they lie in."""
        known = parents.select(*group, F.col("at").alias("in_at"), F.col("slot").alias("in_slot"), "n", "ranks", "below")
        on = _same(counted, known, keys) & (F.col("at") == F.col("in_at")) & (F.col("slot") == F.col("in_slot"))
        taken = [counted[f"`{c}`"] for c in counted.columns]
        return counted.join(known, on).select(*taken, "n", "ranks", "below")

    several = F.col("least") < F.col("most")
    while shift > 0:
        wide = several & (F.col("inside") > most_values) & (F.col("shift") == shift)
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        shift = max(0, shift - bits)
        found = _counted(_entries_within(rows, open_, keys, columns, slots, spread_by), place, shift)
        narrowed = _narrowed(within(open_, found), place).drop("slot").withColumn("shift", F.lit(shift))
        state = materialize(_slotted(state.where(~wide).drop("slot").unionByName(narrowed), group))
    found = _entries_within(rows, state.where(several), keys, columns, slots, spread_by)
    counted = found.groupBy(*place, "v").agg(F.count("*").alias("inside"))
    shown = [*group, "at", "n", F.explode("ranks").alias("rank"), "v"]
    ranked = _narrowed(within(state, counted), place, "v").select(*shown).unionByName(
        state.where(~several).withColumn("v", F.col("least")).select(*shown)
    )

    def quantile(q: Quantile) -> Column:
        mine = F.col("at") == columns.index(q.column)
        place = (F.max(F.when(mine, F.col("n"))) - 1) * F.lit(float(q.fraction))
        own = (F.col("n") - 1) * F.lit(float(q.fraction))
        low, high = (F.max(F.when(mine & (F.col("rank") == side(own)), F.col("v"))) for side in (F.floor, F.ceil))
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low.eqNullSafe(high), low).otherwise(between).alias(q.name)

    result = ranked.groupBy(*group).agg(*[quantile(q) for q in quantiles])
    everyone = groups.select(*group).distinct()
    return everyone.join(result, _same(everyone, result, keys), "left").select(
        *[everyone[f"`{k}`"] for k in keys], *[F.col(f"`{q.name}`") for q in quantiles]
    )
