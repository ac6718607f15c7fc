"""Reading raw people tables and writing enriched ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StringType

from peerbench.functions.numbers import round_places, to_number

INDEX_COLUMNS = ("Unnamed: 0", "_c0")


def read_people(
    spark: SparkSession, path: str | list[str], *, format: str = "csv", schema=None, multiline: bool = True
) -> DataFrame:
    """Read a headered CSV (every column as text, the engine parses) or a parquet table.

    Line breaks inside quoted fields are read as such, at the price of one task per file. With
    ``multiline=False`` large files split; a file that has such line breaks, or rows of another
    width than the header, is then an error when its rows are read.
    """
    if format == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if not multiline:
        schema = schema or reader.csv(path).schema
        # every field of a row is looked at, also if few columns are wanted
        reader = reader.option("mode", "FAILFAST").option("columnPruning", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all cores if it has fewer splits than that; else leave it be.

    Meant for a scan straight from files: small tables in one file would keep one core busy,
    large ones have more splits than cores and are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def null_tokens(df: DataFrame, cols: Iterable[str], tokens: Iterable[str]) -> DataFrame:
    """Turn text that spells a missing value into NULL."""
    tokens = list(tokens)
    longest = max((len(t.encode()) for t in tokens), default=0)  # longer text is not looked up
    return df.withColumns({c: F.when((F.octet_length(c) > longest) | ~F.col(c).isin(tokens), F.col(c)) for c in cols})


def drop_index(df: DataFrame) -> DataFrame:
    return df.drop(*INDEX_COLUMNS)


def add_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Key every row by its content: exact copies share the key, and re-runs give it again."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]))
    return df.withColumn(name, F.sha2(content, 256))


def infer_types(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Give text columns the type their whole content supports, in one pass over the data.

    All whole numbers and nothing missing: BIGINT. All numbers: DOUBLE. Otherwise text.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    cols = [c for c in text if cols is None or c in set(cols)]
    if not cols:
        return df
    checks = []
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        checks += [
            F.count(col).alias(f"present_{i}"),
            F.count(to_number(col)).alias(f"number_{i}"),
            F.count_if(col.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"whole_{i}"),
        ]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *checks).first()
    typed = {}
    for i, c in enumerate(cols):
        present, number, whole = seen[f"present_{i}"], seen[f"number_{i}"], seen[f"whole_{i}"]
        if number < present:
            continue
        exact = present > 0 and whole == present == seen["n"]
        typed[c] = F.col(f"`{c}`").cast("bigint") if exact else to_number(F.col(f"`{c}`"))
    return df.withColumns(typed) if typed else df


def round_floats(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every fractional column; exact decimals leave as doubles like the rest."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType, DecimalType))]
    return df.withColumns({c: round_places(F.col(f"`{c}`").cast("double"), places) for c in fractional})


def write_people(df: DataFrame, path: str, *, format: str = "csv", mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write the table, as a directory of part files: headered CSV or parquet, ``compression`` such as gzip."""
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if format == "parquet":
        writer.parquet(path)
    else:
        # The writer trims text by default.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("escape", '"').csv(path)
