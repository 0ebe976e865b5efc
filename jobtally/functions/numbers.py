"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BYTES_PER_GB = 1024**3

# Colour bands (both ends included; values in the gaps have none).
BANDS = [
    (0, 20, "#ff0000"),
    (21, 60, "#d4a500"),
    (61, 75, "#ffa500"),
    (76, 100, "#008000"),
    (101, 125, "#ffa500"),
    (126, 150, "#ff0000"),
]

# Report labels whose cells get a band.
BANDED_LABELS = [
    "Efficacité mémoire moyenne",
    "Efficacité mémoire médiane",
    "Efficacité mémoire minimum",
    "Efficacité mémoire maximum",
    "Efficacité CPU moyenne",
    "Efficacité CPU médiane",
    "Efficacité CPU minimum",
    "Efficacité CPU maximum",
    "Nom de la règle",
    "Durée moyenne",
    "Durée médiane",
    "Durée (écart-type)",
    "Durée minimum",
    "Durée maximum",
]


def ieee_divide(numerator: Column, denominator: Column) -> Column:
    """Double division with NaN and infinities for a zero denominator, never an error."""
    n, d = numerator.cast("double"), denominator.cast("double")
    at_zero = F.when(
        n.isNotNull() & (d == 0.0),
        F.when((n == 0.0) | F.isnan(n), float("nan"))
        .when(n > 0.0, float("inf"))
        .otherwise(float("-inf")),
    )
    return F.coalesce(n / F.nullif(d, F.lit(0.0)), at_zero)


def bytes_to_gb(c: Column) -> Column:
    return c.cast("double") / F.lit(float(BYTES_PER_GB))


def max_skipping_nan(c: Column) -> Column:
    """Largest value that is a number; NaN only when every value is NaN."""
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))


def round_half_away(c: Column, digits: int) -> Column:
    """Rounding as displayed: scale, round halves away from zero, scale back."""
    scale = float(10**digits)
    return F.round(c * F.lit(scale), 0) / F.lit(scale)


def efficiency_band(value: Column, label: str) -> Column:
    """Colour band of a report cell, or null outside the banded labels and bands."""
    if label not in BANDED_LABELS:
        return F.lit(None).cast("string")
    v = value.try_cast("float")
    band = F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string"))
    band = band.when(v < BANDS[0][0], BANDS[0][2]).when(v > BANDS[-1][1], BANDS[-1][2])
    for low, high, colour in BANDS:
        band = band.when((v >= low) & (v <= high), colour)
    return band
