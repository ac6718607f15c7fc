"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.staging import stage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``value``, without null keys; of rows that share a key, that with the least value
    (null counts as empty). Without shared keys, the usual case, only the key column is read twice
    and the values are not shuffled."""
    df = df.where(F.col(key).isNotNull()).select(key, F.coalesce(value, F.lit("")).alias(value))
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df
    return df.groupBy(key).agg(F.min(value).alias(value))


def carried(docs: DataFrame, columns: list[str] | None) -> tuple[list, str]:
    """Columns to hand through a map unchanged, under names that clash with none, and their schema."""
    kinds = dict(docs.dtypes)
    return [F.col(c).alias(f"{c}__") for c in columns or ()], "".join(f", `{c}__` {kinds[c]}" for c in columns or ())


def uncarried(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The carried columns under their own names, in place of the operator's of those names."""
    if columns is None:
        return df
    own = [c for c in df.columns if not c.endswith("__") and c not in columns]
    return df.select(*[F.col(f"{c}__").alias(c) for c in columns], *own)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``stage`` that lets go of the shuffle files behind the table once it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(key, before)


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components: ``node`` and ``root`` (the least node of its component) for each node of
    ``links``. In each round every node joins its least neighbour, and that one's least neighbour, if
    they are lower; then the links are drawn between what has become one and the next round has only
    those that are left. At least half of the nodes join others, so rounds grow with the logarithm of
    their number. Labels and links are written out each round: lineage stays short and nothing goes
    through the driver but whether links are left."""
    ordered = lambda x, y: [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]
    edges = settle(links.select(*ordered(left, right)).where("x <> y").distinct(), "edges")
    label = None
    while True:
        both = edges.union(edges.select("y", "x"))
        low = settle(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("low")), "lowest")
        step = settle(low.join(low.select(F.col("node").alias("low"), F.col("low").alias("root")), "low").select("node", "root"), "joined")
        if label is None:
            label = step
        else:
            label = settle(label.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        at = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = settle(edges.join(at("x"), "x").join(at("y"), "y").select(*ordered("x_root", "y_root")).where("x <> y").distinct(), "edges")
        if edges.isEmpty():
            return label


def joined_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): only the links between roots are followed."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = settle(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "between")
    moved = components(between)
    new = moved.select("node").join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return settle(roots.union(new).join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
