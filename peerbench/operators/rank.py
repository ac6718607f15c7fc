"""Ranked answers. Missing values sort last in both directions; ties go by the given keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(col: str, descending: bool) -> Column:
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()


def sort_rows(df: DataFrame, col: str, *, ties: Sequence[str], descending: bool = True) -> DataFrame:
    return df.orderBy(ordered(col, descending), *ties)


def top_rows(df: DataFrame, where: Column, col: str, n: int, *, ties: Sequence[str], descending: bool = True) -> DataFrame:
    """The first ``n`` matching rows; every task keeps only its own first ``n``."""
    return sort_rows(df.where(where), col, ties=ties, descending=descending).limit(n)


def top_per_group(
    df: DataFrame, where: Column, group: str, col: str, n: int, *, ties: Sequence[str], descending: bool = True
) -> DataFrame:
    """The first ``n`` matching rows of every group, by group; cut to ``n`` before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(ordered(col, descending), *ties))
    kept = df.where(where).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    return kept.orderBy(F.col(group).asc_nulls_last(), ordered(col, descending), *ties)


def top_groups(summary: DataFrame, metric: str, size: str, min_size: int, n: int, *, ties: Sequence[str]) -> DataFrame:
    """The first ``n`` groups by a metric among those of at least ``min_size`` members."""
    return top_rows(summary, F.col(size) >= min_size, metric, n, ties=ties)


def top_groups_per(
    summary: DataFrame, parent: str, metric: str, size: str, min_size: int, n: int, *, ties: Sequence[str]
) -> DataFrame:
    """The first ``n`` large enough groups inside every parent group."""
    return top_per_group(summary, F.col(size) >= min_size, parent, metric, n, ties=ties)
