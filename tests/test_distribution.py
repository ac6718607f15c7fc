import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerbench.operators import distribution


def frame(spark, values, type_name):
    return spark.createDataFrame([(v,) for v in values], f"v {type_name}")


@pytest.mark.parametrize("kind", ["float", "whole", "log", "constant", "heavy"])
def test_histogram_agrees_with_numpy(spark, kind):
    rng = np.random.default_rng(11)
    values = {
        "float": rng.normal(10, 3, 2000), "whole": rng.integers(0, 12, 2000), "log": rng.lognormal(3, 2, 2000),
        "constant": np.full(50, 4.0), "heavy": np.concatenate([np.full(1500, 2.0), rng.uniform(0, 9, 500)]),
    }[kind]
    df = frame(spark, [v.item() for v in values] + [None], "bigint" if kind == "whole" else "double")
    data = np.log10(values) if kind == "log" else values
    want, edges = np.histogram(data, bins="auto")
    got = distribution.histogram(df, "v", log=kind == "log").orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist()
    assert [r["left"] for r in got] + [got[-1]["right"]] == pytest.approx(edges.tolist(), rel=1e-12)


def test_histogram_leaves_out_what_has_no_logarithm(spark):
    got = distribution.histogram(frame(spark, [-1.0, 0.0, 10.0, 100.0], "double"), "v", 2, log=True).collect()
    assert sum(r["n"] for r in got) == 2
    assert distribution.histogram(frame(spark, [-1.0], "double"), "v", log=True).count() == 0


def test_density(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(500)]
    got = distribution.density(frame(spark, values, "double"), "v").orderBy("point").collect()
    assert len(got) == 200
    x = np.array([r["x"] for r in got])
    h = np.std(values, ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - np.array(values)) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert [r["density"] for r in got] == pytest.approx(want.tolist(), rel=1e-9)
    assert np.trapezoid([r["density"] for r in got], x) == pytest.approx(1, abs=0.05)


def test_sample_is_exact_stable_and_without_repeats(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    first = distribution.sample_rows(df, 300, 42, "k")
    again = distribution.sample_rows(df.repartition(13), 300, 42, "k")
    keys = {r["k"] for r in first.collect()}
    assert len(keys) == 300 and keys == {r["k"] for r in again.collect()}
    other = {r["k"] for r in distribution.sample_rows(df, 300, 43, "k").collect()}
    assert len(other) == 300 and other != keys
    whole = df.orderBy(F.md5(F.concat_ws("-", "k", F.lit("42"))), "k").limit(300)
    assert keys == {r["k"] for r in whole.collect()}


def test_sample_of_a_small_table_is_the_table(spark):
    assert distribution.sample_rows(spark.range(5), 10, 1, "id").count() == 5


def test_top_categories(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [(None,)] * 9, "c string")
    assert sorted(r["c"] for r in distribution.restrict_to_top(df, "c", 2).collect()) == ["a", "a", "a", "b", "b"]
    assert [(r["place"], r["value"], r["n"]) for r in distribution.bar_counts(df, ["c"], 2).orderBy("place").collect()] == [(1, "a", 3), (2, "b", 2)]


def test_scatter_points(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("x"), (F.col("id") - 50).alias("y"))
    assert distribution.scatter_points(df, "x", "y", 1000, 1, "k").count() == 49


def test_hermite_polynomials():
    from numpy.polynomial.hermite import herm2poly

    for k, row in enumerate(distribution.hermite_table(12)):
        assert row == pytest.approx(herm2poly([0] * k + [1]).tolist())


@pytest.mark.parametrize("shape", ["normal", "two far points", "equal steps"])
def test_density_equals_the_sum_of_kernels(spark, shape):
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(size=700), "two far points": np.r_[rng.normal(size=400), 5e3], "equal steps": np.repeat(np.arange(9.0), 50)}[shape]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    got = sorted(tuple(r) for r in distribution.density(df, "v").collect())
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), 200)
    want = np.exp(-0.5 * ((x[:, None] - v[None]) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert [p for p, *_ in got] == list(range(200)) and np.allclose([r[1] for r in got], x)
    assert np.abs(np.array([r[2] for r in got]) - want).max() < 1e-13 / h


def test_scatter_cells_hold_every_point(spark):
    df = spark.createDataFrame([(i, i % 7, float(i % 100)) for i in range(1000)] + [(5000, None, 3.0)], "k int, x int, y double")
    cells = distribution.scatter_cells(df, "x", "y", 10).collect()
    assert sum(r["n"] for r in cells) == 990 and {r["cell_x"] for r in cells} == {0, 1, 3, 5, 6, 8, 9} and max(r["cell_y"] for r in cells) == 9
    assert sum(r["n"] * r["mean_y"] for r in cells) == pytest.approx(sum(i % 100 for i in range(1000)))
    flat = distribution.scatter_cells(df.where("y = 3"), "x", "y").collect()
    assert {r["cell_y"] for r in flat} == {0}
    assert distribution.scatter_cells(df.where("y < 0"), "x", "y").count() == 0
    assert distribution.scatter_points(df, "x", "y", None, 1, "k").count() == 991
