"""Exact quantiles, whole or per group, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Value buckets: no task orders more than about one such share of the distinct values.
BUCKETS = 1_000
# Rows of a group that one task orders; larger groups are cut into value buckets.
LARGE = 100_000


def cut_points(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Inner borders that split the values into about equal shares, from a mergeable sketch."""
    if buckets < 2:
        return []
    df = df.select(F.col(col).cast("double").alias(col))
    shares = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(col, shares, 1.0 / (4 * buckets))))


def with_bucket(df: DataFrame, col: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Number the interval between cut points that each value falls into."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=col, outputCol=name).transform(df)
    return bucketed.withColumn(name, F.col(name).cast("int"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    buckets: int = BUCKETS,
    cuts: Sequence[float] | None = None,
    weight: str | None = None,
    large: int = LARGE,
) -> DataFrame:
    """Linearly interpolated quantiles per group: the keys and ``quantiles`` (array of doubles).

    Missing values are left out, and so are rows with a missing key. Groups of up to ``large`` rows are
    ordered whole, which takes one shuffle. No other group is held in one task:
    values are counted, cut into value buckets of about equal size, the bucket that holds each
    wanted rank is found from the bucket totals, and only those buckets are ordered. A bucket has
    at most about ``1 / buckets`` of all rows, even if one group has all of them. The cuts depend
    on the values alone; calls that differ in their keys can share them. ``weight`` names a column
    that tells how often each row counts.
    """
    keys = list(keys)
    values = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1).cast("bigint")).alias("_w"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .na.drop("any", subset=[*keys, "_v"])
    )
    cuts = cut_points(values, "_v", buckets) if cuts is None else cuts
    if not keys:
        return _ranked_quantiles(values, keys, probs, cuts)
    big = F.broadcast(values.groupBy(*keys).count().where(F.col("count") > large).select(*keys))
    ranked = _ranked_quantiles(values.join(big, keys, "left_semi"), keys, probs, cuts)
    return _ordered_quantiles(values.join(big, keys, "left_anti"), keys, probs).unionByName(ranked)


def _position(p: float) -> Column:
    """The place of a quantile among the values, from 0."""
    return (F.col("_total") - 1) * F.lit(float(p))


def _ranks(probs: Sequence[float]) -> Column:
    """Zero-based ranks below and above each wanted position."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank(_position(p)).cast("bigint").alias("rank"))
            for i, p in enumerate(probs)
            for side, rank in ((0, F.floor), (1, F.ceil))
        ]
    )


def _within(low: Column, high: Column) -> Callable[[Column], Column]:
    return lambda r: (r["rank"] >= low) & (r["rank"] < high)


def _ordered_quantiles(values: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_end", F.sum("_w").over(so_far)).withColumn("_total", F.sum("_w").over(group))
    hits = placed.withColumn("_hit", F.filter(_ranks(probs), _within(F.col("_end") - F.col("_w"), F.col("_end"))))
    return _between(hits, keys, keys, probs)


def _ranked_quantiles(values: DataFrame, keys: list[str], probs: Sequence[float], cuts: Sequence[float]) -> DataFrame:
    # The whole table as one group; its windows see bucket totals or one bucket, never all rows.
    by = keys or ["_all"]
    if not keys:
        values = values.withColumn("_all", F.lit(0))
    counted = with_bucket(values.groupBy(*by, "_v").agg(F.sum("_w").alias("_n")), "_v", cuts, "_b")

    # The join below would add these tests on one of its sides only, and the values would be counted twice.
    for c in (*by, "_b"):
        counted = counted.where(F.col(c).isNotNull())

    # The wanted ranks are kept with the bucket they fall into.
    group = Window.partitionBy(*by)
    totals = (
        counted.groupBy(*by, "_b")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_total", F.sum("_m").over(group))
        .withColumn("_end", F.sum("_m").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_m"))
        .withColumn("_ranks", F.filter(_ranks(probs), _within(F.col("_start"), F.col("_end"))))
        .where(F.size("_ranks") > 0)
        .select(*by, "_b", "_start", "_total", "_ranks")
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counted.join(totals, [*by, "_b"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_hit", F.filter("_ranks", _within(F.col("_end") - F.col("_n"), F.col("_end"))))
    )
    return _between(hits, by, keys, probs)


def _between(hits: DataFrame, by: list[str], keys: list[str], probs: Sequence[float]) -> DataFrame:
    """The quantiles from the values at the wanted ranks."""
    hits = hits.select(*by, "_total", "_v", F.explode("_hit").alias("_hit"))
    picked = hits.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[
            F.max(F.when((F.col("_hit.i") == i) & (F.col("_hit.side") == side), F.col("_v"))).alias(f"_v{i}_{side}")
            for i in range(len(probs))
            for side in (0, 1)
        ],
    )
    quantiles = []
    for i, p in enumerate(probs):
        pos, low, high = _position(p), F.col(f"_v{i}_0"), F.col(f"_v{i}_1")
        between = (F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high
        quantiles.append(F.when(low == high, low).otherwise(between))
    return picked.select(*keys, F.array(*quantiles).alias("quantiles"))
