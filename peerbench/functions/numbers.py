"""Coercing parses, rounding and clamping as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

# Pay is exact, so that "equal to the average" is decided without float error.
PAY = DecimalType(20, 4)

NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(col: Column) -> Column:
    """Parse text as a double; anything that is not a finite plain number becomes NULL.

    The guard keeps out what a Spark cast would accept but a data reader would not
    (``1d``, ``inf``, ``nan``); an exponent too large for a double is dropped as well.
    """
    text = col.cast("string")
    number = F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))
    # Infinity times zero is NaN, all else is kept; unlike a comparison this parses once.
    return F.nanvl(number + number * 0.0, F.lit(None).cast("double"))


def to_pay(col: Column) -> Column:
    return to_number(col).try_cast(PAY)


def years_since(col: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - col


def clamp(col: Column, low: int, high: int) -> Column:
    """Bound to [low, high]; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(col, F.lit(high))))


def round_int(col: Column) -> Column:
    """Round half to even."""
    return F.rint(col).cast(IntegerType())


def round_places(col: Column, places: int) -> Column:
    """Round half to even on the scaled double."""
    factor = float(10**places)
    return F.rint(col * factor) / factor


def log10(col: Column) -> Column:
    """Base-10 logarithm of positive values, NULL elsewhere."""
    value = col.cast("double")
    return F.when(value > 0, F.log10(value))
