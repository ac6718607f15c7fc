"""Segmentation of all rows: K-Means, hierarchical merges of micro-clusters, and profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.config import UNASSIGNED
from peerbench.operators import kmeans
from peerbench.operators.distribution import sample_rows
from peerbench.operators.features import FeatureSpace, fit_features
from peerbench.operators.joins import left_join
from peerbench.operators.kmeans import MAX_CELLS, Stage
from peerbench.operators.merge_tree import cut_tree, ward_merges
from peerbench.operators.profile import row_count, top_values_per_group
from peerbench.operators.tables import assigned, drop_incomplete
from peerbench.staging import Scratch
from peerbench.staging import stage as stage_table


@dataclass(frozen=True)
class Clusters:
    """Rows labelled 0, 1, ... by falling size, with what merging and profiling need. ``passes`` counts the
    passes over the rows, ``rounds`` those of them that moved centres."""

    labelled: DataFrame
    sizes: list[int]
    squared_distances: np.ndarray
    cost: float
    rounds: int
    converged: bool
    passes: int = 0


def _renumbered(sizes: Sequence[int], first: Sequence[float]) -> list[int]:
    """New number of every cluster: by falling size, then by the first coordinate of the centre."""
    order = sorted(range(len(sizes)), key=lambda j: (-sizes[j], first[j]))
    place = [0] * len(sizes)
    for new, old in enumerate(order):
        place[old] = new
    return place


def _lookup(values: Sequence[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def _first(space: FeatureSpace, means: np.ndarray) -> np.ndarray:
    return means[:, 0] if space.numeric else np.zeros(len(means))


def fit_clusters(
    space: FeatureSpace, rows: DataFrame, k: int, *, key: str, restarts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
    label: str = "_cluster", stage: Stage = stage_table, max_cells: int = MAX_CELLS, start: Column | None = None,
) -> Clusters:
    """K-Means over all rows, best of several starts, all of which advance in the same passes; with ``start``, a
    column of given labels from 0 to k - 1, from these alone. ``max_cells`` bounds what the driver holds of the
    centres; beyond it they are tables, with the same result."""
    scratch = Scratch(rows.sparkSession, "kmeans")
    points = kmeans.lay_out(space, rows, key, stage, max_cells, [] if start is None else [start])
    if start is None:
        begin, _ = kmeans.spread_starts(points, [k], restarts, seed, scratch)
    else:
        begin = kmeans.from_labels(points, [k])
    least = [np.inf]

    def keep(f: int, cost: float) -> bool:
        better = cost < least[0]
        least[0] = min(least[0], cost)
        return better

    fits = kmeans.lloyd(points, begin, max_iter, tol, scratch, keep)
    best = min((fit for fit in fits if fit.centres is not None), key=lambda fit: fit.cost)
    return _clusters(points, rows, best.centres, best.sizes, best.cost, label, rounds=max(fit.rounds for fit in fits), converged=best.converged)


def _clusters(points: kmeans.Points, rows: DataFrame, centres: kmeans.Centres, sizes: np.ndarray, cost: float, label: str, **facts) -> Clusters:
    sizes = [int(n) for n in sizes]
    place = _renumbered(sizes, _first(points.space, centres.means))
    order = [j for j in np.argsort(place) if sizes[j]]
    squared = kmeans.squared_distances(points, centres)[np.ix_(order, order)]
    return Clusters(kmeans.labelled(points, rows, centres, place, label), [sizes[j] for j in order], squared, cost, passes=points.passes, **facts)


def _split(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    complete = drop_incomplete(df, cols)
    incomplete = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 1)
    return complete, incomplete


def _with_unassigned(labelled: DataFrame, incomplete: DataFrame, label: str) -> DataFrame:
    return labelled.unionByName(incomplete.withColumn(label, F.lit(UNASSIGNED)))


def kmeans_clusters(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, *, key: str,
    label: str = "KMeans_Cluster", stage: Stage = stage_table, **options,
) -> Clusters:
    """The best fit with all rows labelled: those with a missing feature are -1. ``converged`` is false if it
    stopped at ``max_iter``."""
    complete, incomplete = _split(df, [*numeric, *categorical])
    space = fit_features(complete, numeric, categorical, stage=stage)
    if space.n_rows == 0:
        return Clusters(df.withColumn(label, F.lit(UNASSIGNED)), [], np.zeros((0, 0)), 0.0, 0, True)
    found = fit_clusters(space, complete, k, key=key, label=label, stage=stage, **options)
    return replace(found, labelled=_with_unassigned(found.labelled, incomplete, label))


def kmeans_segments(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, **options) -> DataFrame:
    """All rows with a segment label; rows with a missing feature are -1."""
    return kmeans_clusters(df, numeric, categorical, k, **options).labelled


def fit_facts(spark: SparkSession, found: Clusters) -> DataFrame:
    """(cost, rounds, converged, passes) of a fit."""
    return spark.createDataFrame([(found.cost, found.rounds, found.converged, found.passes)], "cost double, rounds int, converged boolean, passes int")


def elbow(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ks: Sequence[int], *, key: str, sample_size: int | None = None,
    restarts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, stage: Stage = stage_table, max_cells: int = MAX_CELLS,
    start: Callable[[int], Column] | None = None,
) -> DataFrame:
    """(k, cost) of the best fit per k over all complete rows, or over so many sampled ones if
    ``sample_size`` is given; a k beyond the number of rows is left out. All fits, every k and start, advance in
    the same passes. ``start`` may give the labels that the one fit of each k begins with."""
    complete = drop_incomplete(df, [*numeric, *categorical])
    space = fit_features(complete, numeric, categorical, stage=stage)
    rows = space.n_rows
    if sample_size is not None and rows > sample_size:
        complete, rows = sample_rows(complete, sample_size, seed, key), sample_size
    ks = [k for k in ks if k <= rows]
    costs: dict[int, float] = {}
    if ks:
        scratch = Scratch(df.sparkSession, "elbow")
        points = kmeans.lay_out(space, complete, key, stage, max_cells, [start(k) for k in ks] if start else [])
        begin, names = (kmeans.from_labels(points, ks), [(k, 0) for k in ks]) if start else kmeans.spread_starts(points, ks, restarts, seed, scratch)
        for (k, _), fit in zip(names, kmeans.lloyd(points, begin, max_iter, tol, scratch, lambda f, cost: False)):
            costs[k] = min(costs.get(k, np.inf), fit.cost)
    return df.sparkSession.createDataFrame(sorted(costs.items()), "k int, cost double")


def micro_clusters(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, key: str, n: int = 100, seed: int = 42, label: str = "_micro",
    stage: Stage = stage_table, max_cells: int = MAX_CELLS,
) -> Clusters:
    """Many small clusters of all complete rows, the leaves of the hierarchy.

    A few passes draw rows spread over the data, several times ``n``; in one more pass every row joins the
    nearest of them and each task adds up cluster features: the number of rows, sums of their coordinates and
    of their squares. Features of two clusters add up to those of both, so Ward merges go from these to
    ``n`` leaves, and on to the tree, without looking at rows again. Sizes are exact and every row has a leaf.
    ``cost`` is the squared distance to the centres of the leaves.
    """
    complete = drop_incomplete(df, [*numeric, *categorical])
    space = fit_features(complete, numeric, categorical, stage=stage)
    scratch = Scratch(df.sparkSession, "leaves")
    points = kmeans.lay_out(space, complete, key, stage, max_cells)
    drawn = kmeans.from_rows(points, kmeans.drawn_rows(points, [seed], 2 * n))
    features = kmeans.summed(points, drawn, scratch, rows=points.ordered())
    there = np.flatnonzero(features.sizes > 0)
    sizes = features.sizes[there].astype(int).tolist()
    leaf = cut_tree(sizes, ward_merges(sizes, kmeans.squared_distances(points, features)[np.ix_(there, there)]), n)
    number = np.zeros(features.n, int)
    number[there] = leaf
    leaves = kmeans.merged(points, features, number, max(leaf) + 1)
    cost = float(features.squares.sum() - (leaves.sizes * leaves.norms).sum())
    place = _renumbered(leaves.sizes.astype(int).tolist(), _first(space, leaves.means))
    order = np.argsort(place)
    squared = kmeans.squared_distances(points, leaves)[np.ix_(order, order)]
    labels = kmeans.labelled(points, complete, drawn, [place[j] for j in number], label)
    return Clusters(labels, leaves.sizes[order].astype(int).tolist(), squared, cost, 0, True, points.passes)


#: Leaves of a tree; its merges take the square of their number on the driver.
MAX_LEAVES = 5000


def group_leaves(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, key: str, by: str, label: str = "_micro",
    stage: Stage = stage_table, max_cells: int = MAX_CELLS,
) -> Clusters:
    """Leaves that are the groups of a categorical feature: one pass adds up each group's features."""
    complete = drop_incomplete(df, [*numeric, *categorical])
    space = fit_features(complete, numeric, categorical, stage=stage)
    own = space.levels.where(F.col("column") == by)
    first, n = own.agg(F.min("level"), F.count("*")).first()
    if n > MAX_LEAVES:
        raise ValueError(f"{by} has {n} groups; a tree takes up to {MAX_LEAVES}")
    at = f"_i{list(categorical).index(by)}"
    points = kmeans.lay_out(space, complete, key, stage, max_cells)
    points = replace(points, plan=points.plan.withColumn("_label0", F.col(at) - F.lit(first)))
    leaves = kmeans.from_labels(points, [n])
    place = _renumbered(leaves.sizes.astype(int).tolist(), _first(space, leaves.means))
    order = np.argsort(place)
    squared = kmeans.squared_distances(points, leaves)[np.ix_(order, order)]
    numbers = own.select(F.col("value").alias("_value"), _lookup(place, F.col("level") - F.lit(first)).alias(label))
    labels = left_join(complete.withColumn("_value", F.col(by).cast("string")), numbers, ["_value"]).drop("_value")
    cost = float(leaves.squares.sum() - (leaves.sizes * leaves.norms).sum())
    return Clusters(labels, leaves.sizes[order].astype(int).tolist(), squared, cost, 0, True, points.passes)


def merge_tree(spark: SparkSession, micro: Clusters, last: int | None = 12) -> DataFrame:
    """(step, left, right, height, size) of the last merges, or of all."""
    merges = ward_merges(micro.sizes, micro.squared_distances)
    shown = merges if last is None else merges[max(0, len(merges) - last) :]
    rows = [(m.step, m.left, m.right, m.height, m.size) for m in shown]
    return spark.createDataFrame(rows, "step int, left int, right int, height double, size bigint")


def hierarchical_segments(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, *, key: str, n: int = 100,
    label: str = "Hierarchical_Cluster", micro: Clusters | None = None, **options,
) -> DataFrame:
    """All rows with the label of the Ward tree over micro-clusters, cut into k; incomplete rows are -1."""
    complete, incomplete = _split(df, [*numeric, *categorical])
    if micro is None:
        if complete.isEmpty():
            return df.withColumn(label, F.lit(UNASSIGNED))
        micro = micro_clusters(df, numeric, categorical, key=key, n=n, **options)
    leaf = cut_tree(micro.sizes, ward_merges(micro.sizes, micro.squared_distances), k)
    labelled = micro.labelled.withColumn(label, _lookup(leaf, F.col("_micro"))).drop("_micro")
    return _with_unassigned(labelled, incomplete, label)


def assign_to_centroids(df: DataFrame, coordinates: Sequence[Column] | Column, centroids: Sequence[Sequence[float]], label: str) -> DataFrame:
    """Rows with the number of the nearest given centroid (the first on ties).

    Coordinates are either columns or one array column of the centroids' length.
    """

    def squared(centre: Sequence[float]) -> Column:
        if isinstance(coordinates, Column):
            there = F.array(*[F.lit(float(c)) for c in centre])
            return F.aggregate(
                F.zip_with(coordinates, there, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x
            )
        return sum(((x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(coordinates, centre)), F.lit(0.0))

    distances = F.array(*[squared(c) for c in centroids])
    return (
        df.withColumn("_d", distances)
        .withColumn(label, (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))
        .drop("_d")
    )


def _several(df: DataFrame, label: str) -> DataFrame:
    """One row if there is more than one label, else none."""
    return df.agg(F.count_distinct(label).alias("n")).where(F.col("n") > 1).select(F.lit(1).alias("_some"))


def cluster_means(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Means per segment, empty unless there is more than one segment (-1 counts as one)."""
    means = assigned(df, label).groupBy(label).agg(*[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in cols])
    return means.withColumn("_some", F.lit(1)).join(F.broadcast(_several(df, label)), "_some", "left_semi").drop("_some")


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(row_count().alias("size"))


def segment_profile(
    df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], k: int = 5
) -> dict[str, DataFrame]:
    """Means, sizes and most frequent values of the assigned segments; all empty if the rows have one
    label only (-1 counts as one)."""
    rows = assigned(df, label).withColumn("_some", F.lit(1)).join(F.broadcast(_several(df, label)), "_some", "left_semi").drop("_some")
    tables = {"means": cluster_means(df, label, numeric), "sizes": cluster_sizes(rows, label)}
    return tables | {f"top_{c}": top_values_per_group(rows, label, c, k) for c in categorical}
