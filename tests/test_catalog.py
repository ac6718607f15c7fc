import os

import duckdb
import pytest

import __spark_entry__
from verify import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_the_view_in_parts_has_the_same_rows(spark, tmp_path):
    """Also where keys are null, repeat or meet nothing; no order is in two parts."""
    from peerbench.catalog.binding import people_view, people_views

    orders = [(i, i % 7, f"199{i % 10}-03-04") for i in range(40)] + [(3, 99, None), (None, 5, "1999-01-01")]
    items = [(i % 45 if i % 31 else None, i % 6, i % 50, i % 9, 100.25 + i, f"199{i % 9}-05-06") for i in range(300)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": (items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string"),
        "part": ([(i, f"Part {i % 4}") for i in range(48)] + [(41, "again")], "p_partkey long, p_name string"),
        "supplier": ([(i, f"S#{i}") for i in range(8)], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in tables.items():
        table = spark.createDataFrame(rows, schema)
        table.withColumns({c: table[c].cast("timestamp") for c in table.columns if c.endswith("date")}).write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted(map(repr, people_view(spark, str(tmp_path)).collect()))
    views = list(people_views(spark, str(tmp_path), 3, 100))
    found = [v.collect() for v in views]
    assert len(want) > 200 and len(views) == 3 and len(list(people_views(spark, str(tmp_path)))) == 1
    assert sorted(repr(r) for rows in found for r in rows) == want
    keys = [{r["row_id"].split("-")[0] for r in rows} for rows in found]
    assert all(keys) and not (keys[0] & keys[1] or keys[0] & keys[2] or keys[1] & keys[2])
