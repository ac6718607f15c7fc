"""``spark-submit``-style entry: ``python -m peerbench SOURCE TARGET --as-of-year YEAR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from peerbench.config import Settings
from peerbench.plans import run


def main() -> None:
    parser = argparse.ArgumentParser(prog="peerbench", description="Enrich and segment a people table.")
    parser.add_argument("source", help="headered CSV or parquet")
    parser.add_argument("target", help="folder of the enriched table")
    parser.add_argument("--as-of-year", type=int, required=True)
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--restarts", type=int, default=Settings(as_of_year=0).restarts)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("peerbench").getOrCreate()
    settings = Settings(as_of_year=args.as_of_year, restarts=args.restarts)
    for name, table in run(spark, args.source, args.target, settings, format=args.format).items():
        print(f"\n{name}")
        table.show(20, truncate=False)


if __name__ == "__main__":
    main()
