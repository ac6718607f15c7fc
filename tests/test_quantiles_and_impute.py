import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerbench.operators import impute
from peerbench.operators.impute import impute_median, impute_nearest, nearest_means
from peerbench.operators.quantiles import exact_quantiles
from peerbench.staging import stage

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, one value with a third of them, small groups, missing keys and values."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        group = "hot" if i % 10 < 7 else f"g{rng.randint(0, 40)}"
        value = 5.0 if i % 3 == 0 else round(rng.lognormvariate(3, 2), 2)
        rows.append((group if i % 97 else None, value if i % 89 else None))
    rows += [("single", 4.0), ("pair", 1.0), ("pair", 2.0), ("empty", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5), rows


def test_quantiles_per_group(skewed):
    df, rows = skewed
    found = exact_quantiles(df, ["g"], "v", PROBS, buckets=20)
    got = {r["g"]: r["quantiles"] for r in found.collect()}
    groups = {g for g, v in rows if g is not None and v is not None}
    assert set(got) == groups
    for g in groups:
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], PROBS).tolist(), rel=1e-12)


@pytest.mark.parametrize("buckets", [1, 7, 500])
def test_quantiles_of_the_whole_table(skewed, buckets):
    df, rows = skewed
    got = exact_quantiles(df, [], "v", PROBS, buckets=buckets).first()["quantiles"]
    assert got == pytest.approx(np.quantile([v for _, v in rows if v is not None], PROBS).tolist(), rel=1e-12)


def test_impute_median_golden(spark):
    df = spark.createDataFrame([(10,), (None,), (20,), (40,), (30,)], "v int").select(F.col("v").cast("decimal(18,2)").alias("v"))
    assert sorted(r["v"] for r in impute_median(df, "v").collect()) == [10, 20, 25, 30, 40]


def test_impute_median_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert impute_median(df, "v").collect()[0]["v"] is None


def people(spark, rows):
    df = spark.createDataFrame(rows, "row_id string, ctc double, orgyear double")
    return df.withColumn("ctc", F.col("ctc").cast("decimal(20,4)"))


def test_nearest_golden(spark):
    donors = [("a", 10.0, 2000.0), ("b", 20.0, 2001.0), ("c", 40.0, 2010.0)]
    needed = [("x", 12.0, None), ("y", 30.0, None), ("z", 100.0, None)]
    filled = impute_nearest(people(spark, donors + needed), "orgyear", "ctc", 2, "row_id")
    got = {r["row_id"]: r["orgyear"] for r in filled.collect()}
    assert got == {"a": 2000, "b": 2001, "c": 2010, "x": 2000, "y": 2006, "z": 2006}


def test_nearest_with_few_or_no_donors(spark):
    few = impute_nearest(people(spark, [("a", 1.0, 1990.0), ("b", 9.0, None)]), "orgyear", "ctc", 5, "row_id")
    assert {r["row_id"]: r["orgyear"] for r in few.collect()} == {"a": 1990, "b": 1990}
    none = impute_nearest(people(spark, [("a", 1.0, None)]), "orgyear", "ctc", 5, "row_id")
    assert [r["orgyear"] for r in none.collect()] == [None]


def brute_force(rows, k):
    donors = [(Decimal(str(c)), i, y) for i, c, y in rows if y is not None]
    means = {}
    for c in {Decimal(str(c)) for _, c, y in rows if y is None}:
        nearest = sorted(donors, key=lambda d: (abs(d[0] - c), d[0], d[1]))[:k]
        means[c] = sum(y for _, _, y in nearest) / len(nearest)
    return means


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("most", [3, 11, 10**6])
def test_nearest_agrees_with_brute_force(spark, k, most):
    """Ties, equal values, a hot value, sparse ends, and stretches so short that lending matters."""
    rng = random.Random(100 * k + most)
    rows = []
    for i in range(400):
        c = 50.0 if i % 3 == 0 else float(rng.choice([rng.randint(0, 60), rng.randint(0, 5000)]))
        rows.append((f"{i:04d}", c, None if rng.random() < 0.3 else float(rng.randint(1960, 2005))))
    rows += [("x1", -500.0, None), ("x2", 99999.0, None)]
    means = nearest_means(people(spark, rows), "orgyear", "ctc", k, "row_id", stretch=most, stage=stage)
    got = {r["ctc"]: r["_mean"] for r in means.collect()}
    want = brute_force(rows, k)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == pytest.approx(want[c], rel=1e-12), c


def test_many_stretches_pass_donors_on_along_a_tree(spark):
    """More than a hundred stretches, most without donors, in groups of five: three levels."""
    rng = random.Random(8)
    rows = [(f"{i:04d}", float(rng.randint(0, 2000)), float(rng.randint(1960, 2005)) if i % 23 == 0 else None) for i in range(300)]
    means = nearest_means(people(spark, rows), "orgyear", "ctc", 3, "row_id", stretch=2, branches=5)
    assert {r["ctc"]: r["_mean"] for r in means.collect()} == pytest.approx(brute_force(rows, 3), rel=1e-12)


@pytest.mark.parametrize("most", [2, 10])
def test_long_runs_without_donors(spark, most):
    rows = [(f"d{i}", float(c), 1970.0 + i) for i, c in enumerate([1, 2, 3, 500, 501, 9000])]
    rows += [(f"n{c}", float(c), None) for c in [*range(10, 90, 2), *range(5000, 5020), 20000]]
    means = nearest_means(people(spark, rows), "orgyear", "ctc", 4, "row_id", stretch=most)
    assert {r["ctc"]: r["_mean"] for r in means.collect()} == pytest.approx(brute_force(rows, 4), rel=1e-12)


@pytest.mark.parametrize("high, whole", [("99999.5", True), ("9999999999999999.0001", False)])
def test_decimals_are_searched_as_whole_numbers_where_these_hold_them(spark, monkeypatch, high, whole):
    seen, search = [], impute.nearest_to_values
    monkeypatch.setattr(impute, "nearest_to_values", lambda df, *args, **options: seen.append(df.schema["ctc"].dataType.typeName()) or search(df, *args, **options))
    rows = [("a", "0.0001", 1990.0), ("b", "-3.5", 1970.0), ("c", high, 2001.0), ("x", "-1.75", None), ("y", "0", None), ("z", high, None), ("n", None, None)]
    df = spark.createDataFrame(rows, "row_id string, ctc string, orgyear double").withColumn("ctc", F.col("ctc").cast("decimal(20,4)"))
    means = nearest_means(df, "orgyear", "ctc", 1, "row_id")
    assert seen == ["long" if whole else "decimal"] and means.schema["ctc"] == df.schema["ctc"]
    assert {r["ctc"]: r["_mean"] for r in means.collect()} == {Decimal("-1.75"): 1970.0, Decimal(0): 1990.0, Decimal(high): 2001.0}


def test_the_median_ranks_counted_values(spark):
    """Rows are counted once and not looked at again; what is written has one row a value."""
    df = spark.range(6000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 13).cast("decimal(20,4)").alias("v"))
    written = {}
    filled = impute_median(df, "v", stage=lambda table, name: written.setdefault(name, stage(table, name)))
    assert {name: table.count() for name, table in written.items()} == {"values": 14}
    want = float(np.median([i % 13 for i in range(6000) if i % 7]))
    assert filled.where("v is null").isEmpty() and filled.where(F.col("v") == want).count() == sum(i % 7 == 0 or i % 13 == want for i in range(6000))


def test_imputed_years_stay_inside_the_donors(spark):
    rows = [(f"{i}", float(i % 37), None if i % 4 == 0 else 1970.0 + i % 30) for i in range(500)]
    filled = impute_nearest(people(spark, rows), "orgyear", "ctc", 5, "row_id")
    low, high, missing, n = filled.agg(F.min("orgyear"), F.max("orgyear"), F.count_if(F.col("orgyear").isNull()), F.count("*")).first()
    assert 1970 <= low and high <= 1999 and missing == 0 and n == 500


@pytest.mark.parametrize("large", [0, 30, 1_000_000])
def test_quantiles_of_small_and_large_groups(skewed, large):
    df, rows = skewed
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "v", PROBS, buckets=20, large=large).collect()}
    assert set(got) == {g for g, v in rows if g is not None and v is not None}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], PROBS).tolist(), rel=1e-12)


def test_weighted_values_of_one_group(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 9.0, 2), ("a", 9.0, 4), ("b", 2.0, 1)], "g string, v double, n long")
    for large in (0, 100):
        found = exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 1.0], weight="n", large=large)
        assert {r["g"]: r["quantiles"] for r in found.collect()} == {"a": [1.0, 1.0, 9.0, 9.0], "b": [2.0] * 4}


def test_nearest_looks_no_further_than_enough_donors(spark):
    """Values behind others that have k donors between them on one side are not ranked."""
    from peerbench.operators.impute import _enough

    entries = ["struct(5 as v, array(1, 2) as own) as a", "struct(7 as v, array(3) as own) as b", "struct(8 as v, array(4) as own) as c"]
    df = spark.range(1).selectExpr(*entries, "cast(null as struct<v:int,own:array<int>>) as d")
    kept = lambda names, k: [x and x["v"] for x in df.select(*[e.alias(f"e{i}") for i, e in enumerate(_enough(names, k))]).first()]
    assert kept(["a", "b", "c"], 2) == [5, None, None] and kept(["a", "b", "c"], 3) == [5, 7, None]
    assert kept(["a", "b", "c"], 4) == [5, 7, 8] and kept(["c", "d", "d"], 3) == [8, None, None]
