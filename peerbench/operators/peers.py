"""Nested peer-group summaries, their attachment to rows, and the peer flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerbench.config import PEER_FLAGS
from peerbench.functions import peer_flag
from peerbench.operators.joins import left_join
from peerbench.operators.profile import value_counts
from peerbench.operators.quantiles import BUCKETS, cut_points, exact_quantiles
from peerbench.staging import stage, stage_parts

Levels = Mapping[str, Sequence[str]]

# Parts in which rows are joined with their groups at most, and rows of one at least.
PARTS = 4
PART_ROWS = 1_000_000


def _facts(value: str) -> list[Column]:
    col = F.col(value)
    return [F.sum(col).alias("_sum"), F.max(col).alias("_max"), F.min(col).alias("_min"), F.count(col).alias("_count")]


def _average() -> Column:
    return F.when(F.col("_count") > 0, F.col("_sum").cast("double") / F.col("_count"))


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in each group, NULL keys and values too: what all levels are
    summed up from, written once, so that the rows themselves are shuffled once."""
    return stage(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counted")


def _counted_facts(df: DataFrame, value: str) -> list[Column]:
    """``_facts`` over counted values; the sum has the type that a sum over rows has."""
    col, n = F.col(value), F.col("_n")
    total = df.select(F.sum(value)).schema[0].dataType
    present = F.coalesce(F.sum(F.when(col.isNotNull(), n)), F.lit(0))
    return [F.sum(col * n).cast(total).alias("_sum"), F.max(col).alias("_max"), F.min(col).alias("_min"), present.alias("_count")]


def _grouped(counted: DataFrame, facts: list[Column], keys: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    """Sum, extremes, count and exact median per group of non-null keys."""
    rows = counted.where(_complete(keys))
    medians = exact_quantiles(rows, keys, value, [0.5], cuts=cuts, weight="_n")
    medians = medians.select(*keys, F.col("quantiles")[0].alias("_median"))
    return rows.groupBy(*keys).agg(*facts).join(medians, list(keys), "left")


def _named(value: str, suffix: str) -> list[Column]:
    return [
        _average().alias(f"Avg_{value}_{suffix}"),
        F.col("_median").alias(f"Median_{value}_{suffix}"),
        F.col("_max").cast("double").alias(f"Max_{value}_{suffix}"),
        F.col("_min").cast("double").alias(f"Min_{value}_{suffix}"),
        F.col("_count").alias(f"Count_{suffix}"),
    ]


def peer_summary(df: DataFrame, keys: Sequence[str], value: str, suffix: str) -> DataFrame:
    """Mean, median, maximum, minimum and count of a value per group; groups with a NULL key are left out."""
    counted = _counted(df, keys, value)
    return _grouped(counted, _counted_facts(df, value), keys, value, cut_points(counted, value, BUCKETS)).select(*keys, *_named(value, suffix))


def peer_summaries(df: DataFrame, levels: Levels, value: str) -> DataFrame:
    """All levels stacked in one table: ``level``, the finest keys (NULL above their level), the facts.

    A row takes part in each level whose own keys it has, whatever its finer keys are. All levels
    start from the same counted values.
    """
    finest = list(next(iter(levels.values())))
    counted = _counted(df, finest, value)
    cuts = cut_points(counted, value, BUCKETS)
    own = _counted_facts(df, value)
    facts = [
        _average().alias("avg"), F.col("_median").alias("median"),
        F.col("_max").cast("double").alias("max"), F.col("_min").cast("double").alias("min"), F.col("_count").alias("count"),
    ]
    parts = []
    for suffix, keys in levels.items():
        blank = [F.lit(None).cast(df.schema[k].dataType).alias(k) if k not in keys else F.col(k) for k in finest]
        parts.append(_grouped(counted, own, keys, value, cuts).select(F.lit(suffix).alias("level"), *blank, *facts))
    return reduce(DataFrame.unionByName, parts)


def attach_summary(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a summary onto rows; rows of no group keep NULLs. Rows of a frequent group, such as those
    without a company, meet its summary by broadcast and are not gathered."""
    return left_join(df, summary, keys)


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which NULLs are equal. Several keys meet by one number, their hash, so that rows are sorted
    without looking at texts; that all of them are equal is a condition of the join beside it."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    if len(equal) == 1:
        return left.join(renamed, equal[0], "left").drop(f"_k_{keys[0]}")
    renamed = renamed.withColumn("_k", F.xxhash64(*[F.col(f"_k_{k}") for k in keys]))
    # a sum, since plain comparisons would be taken for keys of the join as well
    met = reduce(lambda a, b: a + b, [e.cast("int") for e in equal]) == len(equal)
    return left.join(renamed, (F.xxhash64(*keys) == F.col("_k")) & met, "left").drop("_k", *[f"_k_{k}" for k in keys])


def peer_table(df: DataFrame, levels: Levels, value: str, *, medians: bool = True) -> DataFrame:
    """One row per finest group with the facts of all levels, to be joined to rows once.

    Rows are aggregated map-side first, hence safely under a hot group: to the finest groups, from
    which the coarser levels are rolled up, or, for medians, to the counted values of the finest
    groups. Columns are prefixed by level; a level's facts are NULL where one of its own keys is.
    """
    (finest_name, finest), *coarser = [(s, list(k)) for s, k in levels.items()]
    names = ["_sum", "_max", "_min", "_count"] + (["_median"] if medians else [])
    counted = _counted(df, finest, value) if medians else None
    cuts = cut_points(counted, value, BUCKETS) if medians else []
    roll = [F.sum("_sum").alias("_sum"), F.max("_max").alias("_max"), F.min("_min").alias("_min"), F.sum("_count").alias("_count")]

    def facts(keys: list[str], rolled: DataFrame | None) -> DataFrame:
        if rolled is not None:
            return rolled.groupBy(*keys).agg(*roll)
        return df.groupBy(*keys).agg(*_facts(value)) if counted is None else counted.groupBy(*keys).agg(*_counted_facts(df, value))

    def labelled(part: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        if counted is not None:
            middle = exact_quantiles(counted, keys, value, [0.5], cuts=cuts, weight="_n")
            part = _null_safe_left(part, middle.select(*keys, F.col("quantiles")[0].alias("_median")), keys)
        return part.select(*keys, *[F.when(_complete(keys), F.col(n)).alias(f"{suffix}{n}") for n in names])

    rolled = facts(finest, None)
    wide = labelled(rolled, finest, finest_name)
    for suffix, keys in coarser:
        rolled = facts(keys, rolled)
        wide = _null_safe_left(wide, labelled(rolled, keys, suffix), keys)
    return wide


def attach_peers(
    df: DataFrame,
    levels: Levels,
    value: str,
    *,
    flags: Mapping[str, str] = PEER_FLAGS,
    medians: bool = True,
) -> DataFrame:
    """Rows with the summary columns of all levels and the flags against each level's mean.

    The rows take part in one join, on the finest keys: a company that holds much of the table is
    spread over its roles and years, and what is left of the skew adaptive execution splits.
    """
    return _attached(df, _shown(peer_table(df, levels, value, medians=medians), levels, value, flags, medians), levels, value, flags)


def staged_peers(
    df: DataFrame, levels: Levels, value: str, name: str, *, flags: Mapping[str, str] = PEER_FLAGS, most: int = PARTS, rows: int = PART_ROWS,
) -> DataFrame:
    """``attach_peers``, written to the shared folder.

    The rows pass the join whole, and in a shuffle they take several times the room that they have as a table. They
    and the groups are therefore cut into up to ``most`` parts by a hash of the finest keys, of ``rows`` rows or more
    each, which are joined and written one after the other. ``df`` is read once for each part.
    """
    finest = list(next(iter(levels.values())))
    wide = stage(_shown(peer_table(df, levels, value), levels, value, flags, True), "peers")
    parts = max(1, min(most, df.count() // rows))
    part = lambda table, i: table.where(F.pmod(F.xxhash64(*finest), F.lit(parts)) == i) if parts > 1 else table
    joined = (_attached(part(df, i), part(wide, i), levels, value, flags) for i in range(parts))
    return stage_parts(df.sparkSession, joined, name)


def _facts_of(s: str, value: str, medians: bool) -> list[str]:
    return [f"Avg_{value}_{s}", *([f"Median_{value}_{s}"] if medians else []), f"Max_{value}_{s}", f"Min_{value}_{s}", f"Count_{s}"]


def _shown(wide: DataFrame, levels: Levels, value: str, flags: Mapping[str, str], medians: bool) -> DataFrame:
    """``peer_table`` with the facts as rows get them, so that they are made once a group, and the sums of flagged levels."""
    finest = list(next(iter(levels.values())))
    shown: list[Column] = []
    for s in levels:
        total, count = F.col(f"{s}_sum"), F.col(f"{s}_count")
        facts = [F.when(count > 0, total.cast("double") / count), *([F.col(f"{s}_median")] if medians else [])]
        facts += [F.col(f"{s}_max").cast("double"), F.col(f"{s}_min").cast("double"), count]
        shown += [c.alias(n) for c, n in zip(facts, _facts_of(s, value, medians))]
    return wide.select(*finest, *shown, *[f"{s}_sum" for s in dict.fromkeys(flags.values())])


def _attached(df: DataFrame, shown: DataFrame, levels: Levels, value: str, flags: Mapping[str, str]) -> DataFrame:
    finest = list(next(iter(levels.values())))
    joined = _null_safe_left(df, shown, finest)
    added = [c for c in shown.columns if c not in finest and c not in {f"{s}_sum" for s in flags.values()}]
    flagged = [peer_flag(F.col(value), F.col(f"{s}_sum"), F.col(f"Count_{s}")).alias(flag) for flag, s in flags.items()]
    return joined.select(*df.columns, *added, *flagged)


def flag_counts(df: DataFrame, flags: Sequence[str] = tuple(PEER_FLAGS)) -> DataFrame:
    return value_counts(df, list(flags))
