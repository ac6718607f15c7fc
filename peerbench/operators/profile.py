"""Profile tables: shape, column facts, summaries and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerbench.operators.quantiles import exact_quantiles


def row_count() -> Column:
    return F.count(F.lit(1))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(row_count().alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _per_column(df: DataFrame, cols: Sequence[str], facts: dict) -> DataFrame:
    """One pass of aggregates, then one row per column with one field per fact."""
    one_row = df.agg(
        *[
            F.struct(*[fact(F.col(f"`{c}`")).alias(name) for name, fact in facts.items()]).alias(f"f{i}")
            for i, c in enumerate(cols)
        ]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("f")) for i, c in enumerate(cols)])
    return one_row.select(F.explode(entries).alias("e")).select("e.column", "e.f.*")


def column_info(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type and non-null count of every column."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    kinds = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    counts = _per_column(df, cols, {"non_null": F.count})
    return counts.select("column", kinds[F.col("column")].alias("type"), "non_null")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, list(cols or df.columns), {"missing": lambda c: F.count_if(c.isNull())})


def preview(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    facts = _per_column(
        df,
        cols,
        {
            "count": F.count,
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
        },
    )
    values = unpivot_values(df, cols, "double")
    quartiles = exact_quantiles(values, ["column"], "value", [0.25, 0.5, 0.75])
    q = F.col("quantiles")
    return facts.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max"
    )


def unpivot_values(df: DataFrame, cols: Sequence[str], type_name: str = "string") -> DataFrame:
    """(column, value) rows of the chosen columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(type_name).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def value_counts_by_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequencies of the non-null values of several columns, from one shuffle."""
    values = unpivot_values(df, cols).where(F.col("value").isNotNull())
    return values.groupBy("column", "value").agg(row_count().alias("n"))


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, most frequent value (least value on ties) and its frequency per column."""
    best = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("m"), "value"))
    return (
        value_counts_by_column(df, cols)
        .groupBy("column")
        .agg(F.sum("n").alias("count"), row_count().alias("unique"), best.alias("best"))
        .select("column", "count", "unique", F.col("best.value").alias("top"), F.col("best.n").alias("freq"))
    )


def n_unique(df: DataFrame, cols: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact counts shuffle values, approximate ones do not."""
    if approximate:
        return _per_column(df, cols, {"n_unique": F.approx_count_distinct})
    return value_counts_by_column(df, cols).groupBy("column").agg(row_count().alias("n_unique"))


def value_counts(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Frequencies of the values (or value combinations), most frequent first; missing left out."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.na.drop("any", subset=cols).groupBy(*cols).agg(row_count().alias("n")).orderBy(F.desc("n"), *cols)


def n_repeated(df: DataFrame, col: str) -> DataFrame:
    """How many values occur more than once."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(row_count().alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("n_repeated"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).limit(k)


def top_values_per_group(df: DataFrame, group: str, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of a column inside every group, with their place."""
    counts = df.where(F.col(col).isNotNull()).groupBy(group, col).agg(row_count().alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), col))
    return counts.withColumn("place", place).where(F.col("place") <= k)
