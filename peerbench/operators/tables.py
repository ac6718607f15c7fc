"""Filters, fills and distinct: small steps from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerbench.functions import default_label

#: Words of 64 bits in the bitmap of repeated rows.
WORDS = 1 << 20


def fill_missing(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.na.fill(dict(values))


def match_text(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose text matches the pattern anywhere, in any case; NULL never matches."""
    return df.where(F.coalesce(F.col(col).rlike(f"(?i){pattern}"), F.lit(False)))


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def drop_incomplete(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def null_outside(col: Column, low: int, high: int) -> Column:
    return F.when(col.between(low, high), col)


def assigned(df: DataFrame, label: str, unassigned: int = -1) -> DataFrame:
    return df.where(F.col(label) != unassigned)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of every set of fully equal rows (NULLs equal).

    Only hashes of the rows are shuffled to find those that occur more than once. Of these a bitmap of fixed size
    goes to all tasks: a row whose bit is not set has no copy and stays where it is; the others, copies and some
    that share a bit with one, are compared in full. They meet in the map-side half of the aggregate, so even a
    huge set of copies sends one row per task to the shuffle. ``df`` is read three times.
    """
    if not df.columns:
        return df.dropDuplicates()
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    word = lambda h: F.pmod(h, F.lit(WORDS)).alias("_word")
    bit = lambda h: f"cast(shiftrightunsigned({h}, 58) as int)"
    repeated = df.select(row.alias("_row")).groupBy("_row").count().where("count > 1")
    bitmap = repeated.groupBy(word(F.col("_row"))).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit('_row')})")).alias("_bits"))
    marked = df.withColumn("_row", row).withColumn("_word", word(F.col("_row"))).join(F.broadcast(bitmap), "_word", "left")
    marked = marked.withColumn("_met", F.coalesce(F.expr(f"shiftright(_bits, {bit('_row')}) & 1L"), F.lit(0).cast("bigint")))
    part = lambda met: marked.where(F.col("_met") == met).select(*[F.col(f"`{c}`") for c in df.columns])
    return part(0).unionByName(part(1).dropDuplicates())


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts around a step that drops rows, and their difference."""
    counts = [
        df.agg((F.count(F.lit(1)) * b).alias("rows_before"), (F.count(F.lit(1)) * a).alias("rows_after"))
        for df, b, a in ((before, 1, 0), (after, 0, 1))
    ]
    totals = counts[0].union(counts[1]).agg(*[F.sum(c).alias(c) for c in ("rows_before", "rows_after")])
    return totals.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def attach_labels(
    df: DataFrame, labels: DataFrame, keys: str | list[str], label: str, unassigned: int = -1
) -> DataFrame:
    """Left join of one label per row key; rows without one get ``unassigned``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    joined = df.join(labels.select(*keys, label), keys, "left")
    return joined.select(*df.columns, default_label(F.col(label), unassigned).alias(label))
