"""Three-way comparison with a peer average, and label defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerbench.config import UNASSIGNED

ABOVE, EQUAL, BELOW = 1, 2, 3


def peer_flag(value: Column, total: Column, count: Column) -> Column:
    """1 above, 2 equal to, 3 below the mean ``total / count``; 2 if either side is missing.

    With decimal inputs the test ``value * count`` against ``total`` is exact, whatever order
    the sum was taken in.
    """
    scaled = value * count
    return (
        F.when(scaled.isNull() | total.isNull(), EQUAL)
        .when(scaled > total, ABOVE)
        .when(scaled == total, EQUAL)
        .otherwise(BELOW)
    )


def default_label(col: Column, label: int = UNASSIGNED) -> Column:
    return F.coalesce(col, F.lit(label)).cast("int")
