"""A people table with missing, junk, out-of-range and duplicate values, from the driver tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.config import Settings
from peerbench.sources import spread

SETTINGS = Settings(as_of_year=2005, role_pattern="ring|gear", job="small ring", experience=5, sample_size=5_000, scatter_cap=50_000)


# Parts in which the view is joined at most, and line items of one at least.
PARTS = 2
PART_ROWS = 1_000_000


def people_views(spark: SparkSession, sf_dir: str, most: int = PARTS, rows: int = PART_ROWS) -> Iterator[DataFrame]:
    """``people_view`` in up to ``most`` parts by a hash of the order, so that not all rows are in shuffle files at a time."""
    n = max(1, min(most, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // rows))
    return (people_view(spark, sf_dir, i, n) for i in range(n))


def people_view(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1) -> DataFrame:
    """One row per line item; every 41st part's rows twice. All values are text."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = lambda table, key: table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else table
    # Years instead of dates: shuffled rows are shorter.
    items = own(spread(read("lineitem")), "l_orderkey").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "year(l_shipdate) as l_shipyear")
    rows = (
        items.join(own(read("orders"), "o_orderkey").selectExpr("o_orderkey", "o_custkey", "year(o_orderdate) as o_orderyear"), F.expr("l_orderkey = o_orderkey"))
        .join(read("part"), F.expr("l_partkey = p_partkey"))
        .join(read("supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    bound = rows.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_id",
        "concat('cust-', o_custkey) as email_hash",
        "case when l_partkey % 97 = 0 then null when l_partkey % 89 = 0 then ' ## ' else s_name end as company_hash",
        """case when l_orderkey % 83 = 0 then null when l_orderkey % 79 = 0 then '?!'
                when l_linenumber = 1 then concat(' ', upper(p_name)) else replace(p_name, ' ', '   ') end as job_position""",
        """case when l_orderkey % 50 = 0 then '0' when l_orderkey % 53 = 0 then '20165' when l_orderkey % 59 = 0 then null
                when l_orderkey % 61 = 0 then 'n/k' else cast(l_shipyear as string) end as orgyear""",
        "case when l_orderkey % 211 = 0 then null else cast(cast(l_extendedprice as decimal(18,2)) as string) end as ctc",
        "cast(o_orderyear as string) as ctc_updated_year",
        "explode(case when l_partkey % 41 = 0 then array(1, 2) else array(1) end) as copy",
    )
    return bound.drop("copy")
