"""A left join that does not send the rows of a frequent key to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: A key with more than this share of the rows is frequent; so there are less than 1 / SHARE of them.
SHARE = 1 / 64


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> DataFrame:
    """The keys, without nulls, that hold more than ``share`` of the rows: less than 1 / share of them."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).count().where(F.col("count") > df.count() * share).select(*keys)


def left_join(df: DataFrame, table: DataFrame, keys: Sequence[str], *, frequent: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """``df`` with the columns of ``table``, which has a key at most once; NULLs where it has none.

    Rows of ``frequent`` keys (found by one aggregate unless they are given) get their table row by broadcast.
    They and rows with a null key then go through the join by a hash of the whole row instead of their key,
    so that none of its tasks gets more than its part of them, whatever adaptive execution does.
    """
    keys = list(keys)
    more = [c for c in table.columns if c not in keys]
    heavy = frequent_keys(df, keys, share) if frequent is None else frequent
    few = table.join(F.broadcast(heavy), keys, "left_semi").select(*keys, F.struct(F.lit(True).alias("met"), *more).alias("_few"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    apart = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(1 << 20)) + 1
    marked = df.join(F.broadcast(few), keys, "left")
    marked = marked.withColumn("_apart", F.when(F.col("_few").isNotNull() | ~known, apart).otherwise(F.lit(0).cast("bigint")))
    # always 0, but not a constant, which would be taken out of the keys of the join
    zero = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1).cast("bigint"))
    joined = marked.join(table.withColumn("_apart", zero), [*keys, "_apart"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(F.col("_few")[c], F.col(f"`{c}`")).alias(c) for c in more])
