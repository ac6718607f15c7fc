import pytest
from pyspark.sql import functions as F

from peerbench.operators.joins import frequent_keys, left_join


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 300}", i % 7) for i in range(6000)] + [(-i, None, 1) for i in range(500)] + [(9000, "none", 2)]
    df = spark.createDataFrame(rows, "id int, k string, n int").repartition(6)
    table = spark.createDataFrame([("hot", 1, "x")] + [(f"k{i}", i, None) for i in range(0, 300, 2)], "k string, v int, w string")
    return df, table


def test_equals_a_plain_left_join(tables):
    df, table = tables
    got = sorted(map(str, left_join(df, table, ["k"]).collect()))
    assert got == sorted(map(str, df.join(table, "k", "left").select("id", "k", "n", "v", "w").collect()))
    assert [r["k"] for r in frequent_keys(df, ["k"]).collect()] == ["hot"]
    assert left_join(df.limit(0), table, ["k"]).count() == 0
    two = table.withColumn("n", F.lit(1))
    assert left_join(df, two, ["k", "n"]).where("v is not null").count() == df.join(two, ["k", "n"]).count()


def test_no_task_gets_a_hot_key(spark, tables):
    """With adaptive execution off and no broadcast of the table: the largest partition of the join."""
    df, table = tables
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        sizes = lambda x: [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes(df.join(table, "k", "left"))) > 3500
        assert max(sizes(left_join(df, table, ["k"]))) < 2 * 6501 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
