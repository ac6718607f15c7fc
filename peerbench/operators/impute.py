"""Filling gaps: exact median, and the mean of the exactly nearest rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from peerbench.functions import round_int
from peerbench.operators.joins import left_join
from peerbench.operators.quantiles import exact_quantiles
from peerbench.staging import stage as stage_table

# Whole numbers up to which distances of two of them are whole numbers of 64 bits.
WHOLE = 1 << 62

# Distinct values per ordered stretch of the nearest search, and stretches that exchange donors at once.
STRETCH = 250_000
BRANCHES = 64


def impute_median(df: DataFrame, col: str, *, stage: Callable[[DataFrame, str], DataFrame] = stage_table) -> DataFrame:
    """Fill missing values with the exact median of the rest (all missing: nothing to fill with)."""
    if df.where(F.col(col).isNull()).isEmpty():
        return df
    # Values are counted and written once: what is ranked, the cuts between buckets too, starts from distinct values.
    values = df.select(F.col(col).cast("double").alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    row = exact_quantiles(stage(values, "values"), [], "_v", [0.5], weight="_n").first()
    if row is None or row["quantiles"] is None:
        return df
    median = F.lit(row["quantiles"][0]).cast(df.schema[col].dataType)
    return df.withColumn(col, F.coalesce(F.col(col), median))


def nearest_means(
    df: DataFrame, target: str, by: str, k: int, key: str, *, stretch: int = STRETCH,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table, branches: int = BRANCHES,
) -> DataFrame:
    """``nearest_to_values``, on whole numbers where ``by`` is a decimal whose values, without the point, fit them: order
    and distances are the same, and they are compared and sorted in a fraction of the time."""
    options = {"stretch": stretch, "stage": stage, "branches": branches}
    kind = df.schema[by].dataType
    if not isinstance(kind, DecimalType) or kind.precision + kind.scale > 36:
        return nearest_to_values(df, target, by, k, key, **options)
    ends = [abs(x) for x in df.agg(F.min(by), F.max(by)).first() if x is not None]
    if any(x.scaleb(kind.scale) >= WHOLE for x in ends):
        return nearest_to_values(df, target, by, k, key, **options)
    whole = df.select(key, target, (F.col(by) * F.lit(Decimal(10**kind.scale))).cast("bigint").alias(by))
    found = nearest_to_values(whole, target, by, k, key, **options)
    return found.withColumn(by, (F.col(by).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(kind))


def nearest_to_values(
    df: DataFrame, target: str, by: str, k: int, key: str, *, stretch: int = STRETCH,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table, branches: int = BRANCHES,
) -> DataFrame:
    """For every value of ``by`` on a row lacking ``target``: the mean ``target`` of the k nearest rows.

    Ties go to the lower value, then the lower key. Returns ``by``, ``_mean``. The plan is one
    ordered walk, not a join of pairs:

    1. per distinct value keep its first k donors, and list the values that need an answer;
    2. deal all these values out by ranges into stretches of about equal length, and lend each stretch the k
       donor values next below and above it, wherever they are, so that no answer lies outside it;
    3. in value order within a stretch, a needed value looks back and ahead over k donor values, and past those
       that have k donors between them on its side no further;
    4. the k nearest of the donors found there are averaged.
    """
    have, need = F.col(target).isNotNull(), F.col(target).isNull()
    first = Window.partitionBy(by).orderBy(key)
    donors = (
        df.where(have & F.col(by).isNotNull())
        .select(by, key, target)
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= k)
        .groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("_place", F.col(target).alias("t")))).alias("_own"))
    )
    needed = df.where(need & F.col(by).isNotNull()).select(by).distinct()
    donors, needed = stage(donors, "donors"), stage(needed, "needed")
    wanted = _stretches(donors.count() + needed.count(), stretch, df.sparkSession.sparkContext.defaultParallelism)
    both = donors.select(by, "_own").unionByName(needed.select(by), allowMissingColumns=True)
    both = stage(both.repartitionByRange(wanted, by).withColumn("_s", F.spark_partition_id()), "stretches")
    donors, needed = both.where(F.col("_own").isNotNull()).select("_s", by, "_own"), both.where(F.col("_own").isNull()).select("_s", by)
    if wanted > 1:
        donors = donors.unionByName(_lent(donors, by, k, wanted, stage, branches))

    # A donor value comes before an equal needed one. Needed values hold no entry and are stepped over.
    entry = F.struct(F.col(by).alias("v"), F.col("_own").alias("own"))
    walked = donors.select("_s", by, F.lit(0).alias("_ask"), entry.alias("_entry")).unionByName(
        needed.select("_s", by, F.lit(1).alias("_ask")), allowMissingColumns=True
    )
    window = f"OVER (PARTITION BY _s ORDER BY `{by}`, _ask)"
    looks = {f"_{way}{i}": F.expr(f"{way}(_entry, {i}) IGNORE NULLS {window}") for way in ("lag", "lead") for i in range(1, k + 1)}
    asked = walked.select(by, "_ask", *[look.alias(name) for name, look in looks.items()]).where(F.col("_ask") == 1)
    asked = asked.select(by, F.array(*_enough(list(looks)[:k], k), *_enough(list(looks)[k:], k)).alias("_near"))
    distance = lambda e: F.abs(e["v"] - F.col(by))
    candidates = F.flatten(
        F.transform(
            F.array_compact("_near"),
            lambda e: F.transform(
                e["own"], lambda d: F.struct(distance(e).alias("d"), e["v"].alias("v"), d["_place"].alias("p"), d["t"].alias("t"))
            ),
        )
    )
    ranked = F.sort_array(candidates)
    nearest = F.slice(ranked, 1, k)
    total = F.aggregate(nearest, F.lit(0.0), lambda acc, c: acc + c["t"].cast("double"))
    return asked.select(by, F.when(F.size(nearest) > 0, total / F.size(nearest)).alias("_mean"))


def _enough(entries: Sequence[str], k: int) -> list[Column]:
    """Donor values of one side, nearest first; NULL for those behind others that have k donors between them."""
    met, out = F.lit(0), []
    for entry in entries:
        out.append(F.when(met < k, F.col(entry)))
        met = met + F.coalesce(F.array_size(F.col(entry)["own"]), F.lit(0))
    return out


def _stretches(values: int, most: int, cores: int) -> int:
    """Enough stretches to keep each below ``most`` values, and the cores busy on smaller inputs."""
    return max(1, -(-values // most), min(cores, values // 10_000))


def _ends(donors: Column, k: int) -> tuple[Column, Column]:
    """The first and the last k of an ordered array."""
    return F.slice(donors, 1, k), F.slice(donors, F.greatest(F.size(donors) - k + 1, F.lit(1)), k)


def _lent(donors: DataFrame, by: str, k: int, stretches: int, stage: Callable[[DataFrame, str], DataFrame], branches: int) -> DataFrame:
    """For each stretch the k donors next below it and the k next above it, as further rows of it.

    Only the outermost k donors of a stretch can be among them. Stretches pass these on along a tree: up, each
    group of ``branches`` neighbours adds up to its own outermost donors; down, each gets those next to its
    group, and hands every member these with its siblings' on either side. A group is 2 k donors of each of its
    members, whatever the number of stretches.
    """
    inside = Window.partitionBy("_s")
    edge = F.struct(F.col(by).alias("v"), F.col("_own").alias("own"))
    edges = (
        donors.withColumn("_r", F.row_number().over(inside.orderBy(by)))
        .withColumn("_m", F.count("*").over(inside))
        .where((F.col("_r") <= k) | (F.col("_r") > F.col("_m") - k))
        .groupBy("_s").agg(F.array_sort(F.collect_list(edge)).alias("_d"))
    )
    low, high = _ends(F.col("_d"), k)
    level = donors.sparkSession.range(stretches).select(F.col("id").alias("_g")).join(edges.withColumnRenamed("_s", "_g"), "_g", "left")
    level = level.withColumn("_d", F.coalesce("_d", _empty(edges, "_d")))
    levels, groups = [stage(level.select("_g", low.alias("low"), high.alias("high")), "edges")], stretches
    members = F.array_sort(F.collect_list(F.struct("_g", "low", "high"))).alias("members")
    of_group = lambda table: table.groupBy(F.expr(f"_g div {branches}").alias("_up")).agg(members)
    flat = lambda rows, side: F.flatten(F.transform(rows, lambda m: m[side]))
    while groups > branches:
        up = of_group(levels[-1]).select(F.col("_up").alias("_g"), _ends(flat(F.col("members"), "low"), k)[0].alias("low"), _ends(flat(F.col("members"), "high"), k)[1].alias("high"))
        levels.append(stage(up, "edges"))
        groups = -(-groups // branches)
    lent = of_group(levels[-1]).select("_up", "members", _empty(levels[-1], "low").alias("below"), _empty(levels[-1], "low").alias("above"))
    for depth in reversed(range(len(levels))):
        if depth < len(levels) - 1:
            lent = of_group(levels[depth]).join(lent.withColumnRenamed("_g", "_up"), "_up")
        before = lambda i: F.concat(F.col("below"), flat(F.slice("members", 1, i), "high"))
        after = lambda i: F.concat(flat(F.slice("members", i + 2, F.size("members")), "low"), F.col("above"))
        handed = F.transform(
            F.col("members"),
            lambda m, i: F.struct(m["_g"].alias("_g"), _ends(before(i), k)[1].alias("below"), _ends(after(i), k)[0].alias("above")),
        )
        lent = stage(lent.select(F.explode(handed).alias("h")).select("h.*"), "lent")
    return lent.select(F.col("_g").cast("int").alias("_s"), F.explode(F.concat("below", "above")).alias("_d")).select("_s", F.col("_d.v").alias(by), F.col("_d.own").alias("_own"))


def _empty(table: DataFrame, col: str) -> Column:
    """An empty array of the kind of ``col``."""
    return F.array().cast(table.schema[col].dataType)


def impute_nearest(
    df: DataFrame, target: str, by: str, k: int, key: str, *, stretch: int = STRETCH,
    stage: Callable[[DataFrame, str], DataFrame] = stage_table,
) -> DataFrame:
    """Fill a missing whole number with the half-even rounded mean of the k rows nearest by ``by``.

    Complete rows pass through without a shuffle; only the rows to fill join the table of means, those of a
    frequent value by broadcast.
    """
    if df.where(F.col(target).isNull()).isEmpty():
        return df
    means = nearest_means(df, target, by, k, key, stretch=stretch, stage=stage)
    filled = (
        left_join(df.where(F.col(target).isNull()), means, [by])
        .withColumn(target, round_int(F.col("_mean")).cast(df.schema[target].dataType))
        .select(*df.columns)
    )
    # Later steps read the rows more than once; the search is not run again for that.
    filled = stage(filled, "filled")
    return df.where(F.col(target).isNotNull()).unionByName(filled)
