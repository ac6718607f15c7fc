import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerbench.operators import peers, profile, rank, tables

LEVELS = {"fine": ["a", "b"], "coarse": ["a"]}
FLAGS = {"f_fine": "fine", "f_coarse": "coarse"}


def table(spark, rows, schema="id string, a string, b string, pay decimal(20,4)"):
    return spark.createDataFrame([(i, a, b, None if p is None else Decimal(str(p))) for i, a, b, p in rows], schema)


def flags_of(df):
    return {r["id"]: (r["f_fine"], r["f_coarse"]) for r in df.collect()}


def test_flags_golden(spark):
    df = table(spark, [("1", "A", "x", 10), ("2", "A", "x", 20), ("3", "A", "x", 30), ("4", "B", "y", 7)])
    got = flags_of(peers.attach_peers(df, LEVELS, "pay", flags=FLAGS))
    assert {i: f[1] for i, f in got.items()} == {"1": 3, "2": 2, "3": 1, "4": 2}


def test_flags_of_missing_pay_and_missing_keys(spark):
    rows = [("1", "A", "x", None), ("2", "A", "x", 5), ("3", None, "x", 5), ("4", "A", None, 9), ("5", "C", "z", None)]
    got = flags_of(peers.attach_peers(table(spark, rows), LEVELS, "pay", flags=FLAGS))
    # Row 4 has no fine group but is above the mean (7) of its coarse one.
    assert got == {"1": (2, 2), "2": (2, 3), "3": (2, 2), "4": (2, 1), "5": (2, 2)}


def random_rows(n=3000):
    rng = random.Random(5)
    return [
        (str(i), "hot" if i % 3 == 0 else f"c{rng.randint(0, 30)}", f"j{rng.randint(0, 6)}", rng.randint(1, 40) / 4 if i % 50 else None)
        for i in range(n)
    ]


@pytest.mark.parametrize("medians", [True, False])
def test_attached_facts_agree_with_pandas(spark, medians):
    rows = random_rows()
    got = peers.attach_peers(table(spark, rows), LEVELS, "pay", flags=FLAGS, medians=medians).toPandas()
    want = pd.DataFrame(rows, columns=["id", "a", "b", "pay"])
    for s, keys in LEVELS.items():
        g = want.groupby(keys)["pay"]
        want[f"Avg_pay_{s}"], want[f"Median_pay_{s}"] = g.transform("mean"), g.transform("median")
        want[f"Max_pay_{s}"], want[f"Count_{s}"] = g.transform("max"), g.transform("count")
    both = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(both) == len(rows)
    for s in LEVELS:
        for c in [f"Avg_pay_{s}", f"Max_pay_{s}", f"Count_{s}"] + ([f"Median_pay_{s}"] if medians else []):
            assert both[c].astype(float).to_list() == pytest.approx(both[f"{c}_w"].to_list(), rel=1e-12), c


def test_flag_sums(spark):
    """No group is all above or all below; a group of one is equal."""
    flagged = peers.attach_peers(table(spark, random_rows()), LEVELS, "pay", flags=FLAGS, medians=False).where(F.col("pay").isNotNull())
    groups = flagged.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("f_fine").alias("low"), F.max("f_fine").alias("high"), F.count_if(F.col("f_fine") == 2).alias("same")
    )
    assert groups.where("n = 1 and same = 0").count() == 0
    assert groups.where("low = high and low <> 2").count() == 0


def test_summaries_of_all_levels(spark):
    """Each level has the rows that have its own keys, whatever their finer ones."""
    rows = [("1", "A", "x", 1), ("2", "A", None, 50), ("3", "B", "y", 7), ("4", "B", None, 9), ("5", None, "y", 3), ("6", "C", "z", None)]
    got = {(r["level"], r["a"], r["b"]): (r["avg"], r["median"], r["min"], r["max"], r["count"]) for r in peers.peer_summaries(table(spark, rows), LEVELS, "pay").collect()}
    none = (None, None, None, None, 0)
    assert got == {
        ("fine", "A", "x"): (1, 1, 1, 1, 1), ("fine", "B", "y"): (7, 7, 7, 7, 1), ("fine", "C", "z"): none,
        ("coarse", "A", None): (25.5, 25.5, 1, 50, 2), ("coarse", "B", None): (8, 8, 7, 9, 2), ("coarse", "C", None): none,
    }
    df = table(spark, random_rows())
    for level, keys in LEVELS.items():
        single = peers.peer_summary(df, keys, "pay", level).collect()
        stacked = peers.peer_summaries(df, LEVELS, "pay").where(F.col("level") == level).collect()
        assert sorted((*[r[k] for k in keys], *r[-5:]) for r in stacked) == sorted((*[r[k] for k in keys], *r[-5:]) for r in single)


def test_ties_and_missing_last(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 5)], "row_id string, pay int")
    assert [r["row_id"] for r in rank.top_rows(df, F.lit(True), "pay", 2, ties=["row_id"]).collect()] == ["a", "b"]
    df = spark.createDataFrame([("c", None), ("a", 3), ("b", 1)], "row_id string, pay int")
    order = lambda d: [r["pay"] for r in rank.sort_rows(df, "pay", ties=["row_id"], descending=d).collect()]
    assert order(False) == [1, 3, None] and order(True) == [3, 1, None]


def test_top_per_group(spark):
    rows = [(f"{i:03d}", "hot" if i % 3 else "cold", i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id string, g string, pay int")
    got = [(r["g"], r["pay"], r["row_id"]) for r in rank.top_per_group(df, F.col("pay") > 0, "g", "pay", 3, ties=["row_id"]).collect()]
    want = []
    for g in ("cold", "hot"):
        want += sorted([(g, p, i) for i, h, p in rows if h == g and p > 0], key=lambda t: (-t[1], t[2]))[:3]
    assert got == want


def test_top_groups_need_members(spark):
    df = table(spark, [("1", "A", "x", 100)] + [(f"b{i}", "B", "x", 10) for i in range(10)])
    summary = peers.peer_summary(df, ["a"], "pay", "s")
    assert [r["a"] for r in rank.top_groups(summary, "Avg_pay_s", "Count_s", 10, 5, ties=["a"]).collect()] == ["B"]


def test_duplicates(spark):
    df = spark.createDataFrame([("A", "a", None), ("A", "a", None), ("A.", "a", 1)], "raw string, cleaned string, n int")
    once = tables.drop_duplicate_rows(df)
    assert once.count() == 2 and tables.drop_duplicate_rows(once).count() == 2
    assert tables.removed_rows(df, once).first().asDict() == {"rows_before": 3, "rows_after": 2, "rows_removed": 1}


def test_text_match(spark):
    df = spark.createDataFrame([("Data SCIENCE lead",), ("chef",), (None,)], "job string")
    assert [r[0] for r in tables.match_text(df, "job", "data scientist|data science").collect()] == ["Data SCIENCE lead"]


def test_profile_tables(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 3.0), (None, 4.0)], "s string, v double")
    assert {r["column"]: r["missing"] for r in profile.null_counts(df).collect()} == {"s": 1, "v": 1}
    assert {(r["column"], r["type"], r["non_null"]) for r in profile.column_info(df).collect()} == {("s", "string", 3), ("v", "double", 3)}
    assert profile.shape(df).first().asDict() == {"n_rows": 4, "n_columns": 2}
    facts = profile.describe_categorical(df, ["s"]).first().asDict()
    assert facts == {"column": "s", "count": 3, "unique": 2, "top": "x", "freq": 2}
    numbers = profile.describe_numeric(df, ["v"]).first().asDict()
    want = pd.Series([1.0, 3.0, 4.0]).describe()
    assert [numbers[k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(want.to_list())
    assert [tuple(r) for r in profile.value_counts(df, "s").collect()] == [("x", 2), ("y", 1)]
    assert profile.n_repeated(df, "s").first()[0] == 1
    assert profile.n_unique(df, ["s"], approximate=True).first()["n_unique"] == 2


def test_labels_by_key(spark):
    df = spark.createDataFrame([("a",), ("b",)], "row_id string")
    labels = spark.createDataFrame([("a", 3)], "row_id string, label bigint")
    assert {tuple(r) for r in tables.attach_labels(df, labels, "row_id", "label").collect()} == {("a", 3), ("b", -1)}


def test_duplicates_of_all_kinds(spark):
    rows = [(i, f"t{i % 50}", None if i % 7 else float(i)) for i in range(3000)]
    rows += rows[:500] + [(None, None, None)] * 40 + [(-1, "z", float("nan"))] * 3 + [(-2, "z", 0.0), (-2, "z", -0.0)]
    df = spark.createDataFrame(rows, "a long, `b.c` string, d double").repartition(6)
    got = [tuple(r) for r in tables.drop_duplicate_rows(df).collect()]
    assert len(got) == 3000 + 1 + 1 + 1
    assert {r for r in got if r[0] is not None and r[0] >= 0} == set(rows[:3000])


@pytest.mark.parametrize("size, parts", [(1000, 3), (10_000, 1)])
def test_rows_joined_part_by_part(spark, size, parts):
    """Missing keys and pay too; every part has its own folder, and no group is in two of them."""
    rows = [(i, None if int(i) % 11 == 0 else a, None if int(i) % 7 == 0 else b, p) for i, a, b, p in random_rows()]
    df = table(spark, rows)
    found = peers.staged_peers(df, LEVELS, "pay", "staged", flags=FLAGS, rows=size)
    want = peers.attach_peers(df, LEVELS, "pay", flags=FLAGS)
    assert found.dtypes == want.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    assert found.select(folder).distinct().count() == parts
    assert found.groupBy("a", "b").agg(F.count_distinct(folder).alias("n")).where("n > 1").isEmpty()


def test_rows_joined_part_by_part_of_no_rows(spark):
    assert peers.staged_peers(table(spark, []), LEVELS, "pay", "staged", flags=FLAGS).count() == 0


def test_several_keys_meet_by_their_hash(spark):
    """Nulls are equal, and groups whose hashes are equal are told apart: of nulls a hash knows the number only."""
    df = table(spark, [("1", None, "x", 10), ("2", "x", None, 20), ("3", None, "x", 30), ("4", None, None, 5), ("5", "x", "x", 7), ("6", "x", None, 40)])
    found = peers.attach_peers(df, LEVELS, "pay", flags=FLAGS)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in text
    rows = peers._null_safe_left(df.select("a", "b"), df.groupBy("a", "b").count(), ["a", "b"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, df.join(df.groupBy("a", "b").count().withColumnsRenamed({"a": "c", "b": "d"}), F.expr("a <=> c and b <=> d"), "left").select("a", "b", "count").collect()))
    assert len(rows) == 6 and found.count() == 6
