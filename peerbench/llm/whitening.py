"""Embedding whitening with components found by slicing the spectrum of the covariance.

A vector's entries c become whole numbers x = floor(256 c). The fit list is each distinct x once, so copies
weigh nothing. Tasks add up whole-number sums, then products of centred rows, d x d numbers each however many
rows they have; Spark adds those up, and the driver gets one matrix of the size of a vector squared, whose
leading eigenpairs :mod:`peerbench.llm.spectrum` finds. Two maps follow: the covariance of the whitened fit
list, for the error of the result, and the rows themselves.

Defined results: rows whose vector is null, empty or holds null or non-finite entries take no part; nor do
those of another length than most distinct vectors have (ties: the longer). Every other row, repeated ones
and those with a null id too, gives a row for each component. A component whose eigenvalue is zero up to
rounding is left out, so n equal vectors, or an empty table, give no rows. Entries beyond 2^62 / 256 count as
that. ``deviation`` is exact, and null beyond 38 digits. Other columns are not read. The sign of a component is
that with its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.spectrum import leading
from peerbench.llm.tables import settle

BOUND = 2.0**62
ROWS = 4096


def lattice(column: pa.Array, scale: float = 256.0) -> tuple[np.ndarray, pa.ListArray]:
    """Which rows take part, and their vectors as whole numbers."""
    lists = column.cast(pa.large_list(pa.float64()))
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    good = size > 0
    flat = lists.flatten()
    entries = np.asarray(flat.fill_null(np.nan), float)
    ptr = np.r_[0, np.cumsum(size)]
    bad = np.r_[0, np.cumsum(~np.isfinite(entries))]
    good &= bad[ptr[1:]] == bad[ptr[:-1]]
    kept = entries[np.repeat(good, size)]
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(kept * scale), -BOUND, BOUND).astype(np.int64)
    return good, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[good])].astype(np.int32)), pa.array(x))


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = lattice(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), x], names=["id", "x"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id bigint, x array<bigint>")


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.asarray(part.column(column).flatten()).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, in whole numbers."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for _, x in _blocks(batches, 0, d):
            n += len(x)
            small = float(np.abs(x).max(initial=0)) * ROWS < BOUND
            total = total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        values = [Decimal(n), *(Decimal(int(s)) for s in total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "s"])

    found = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in found}
    return sums.get(0, 0), [sums.get(i + 1, 0) for i in range(d)]


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they suffice for its squares too, else Python's."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * x.shape[1] < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def summed_products(rows: DataFrame, width: int, turn) -> np.ndarray:
    """The sum over all rows of the outer products of ``turn(x)``; each task sends one matrix, entry by entry."""
    i, j = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for x in turn(batches):
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    added = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    a, b, v = (added[c].to_numpy() for c in ("i", "j", "v"))
    out[a, b] = v
    out[b, a] = v
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``id_col``, component, n, deviation (DECIMAL), whitened, explained, identity_error."""
    schema = f"`{id_col}` bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    points = whole_numbers(df, id_col, vector_col)
    fit = settle(points.select("x").distinct(), "fit_list")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return df.sparkSession.createDataFrame([], schema)
    d = length["d"]
    fit = fit.where(F.size("x") == d)
    n, sums = exact_sums(fit, d)

    def centred(x: np.ndarray) -> np.ndarray:
        return (scaled_deviation(x, n, sums) / n).astype(float)

    covariance = summed_products(fit, d, lambda batches: (centred(x) for _, x in _blocks(batches, 0, d))) / n
    values, vectors = leading(covariance, components)
    k = len(values)
    turn = vectors.T / np.sqrt(values)
    explained = values / covariance.trace() if k else values
    error = 0.0
    if k:
        # a column of ones beside the components: its products are their sums
        ones = lambda batches: (np.c_[centred(x) @ turn, np.ones(len(x))] for _, x in _blocks(batches, 0, d))
        moments = summed_products(fit, k + 1, ones) / n
        mean = moments[k, :k]
        error = float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        for batch, x in _blocks(batches, 1, d):
            off = scaled_deviation(x, n, sums)
            square = (off * off).sum(axis=1)
            if square.dtype == object:
                deviation = pa.array([Decimal(int(s)) if s < 10**38 else None for s in square], pa.decimal128(38, 0))
            else:
                deviation = pa.array(square).cast(pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            rows = len(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, n, np.int64)), deviation.take(at),
                 pa.array(((off / n).astype(float) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(rows, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.where(F.size("x") == d).mapInArrow(run, schema)
