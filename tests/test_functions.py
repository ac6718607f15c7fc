import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from peerbench.functions import clamp, clean_text, default_label, empty_to, peer_flag, round_int, round_places, to_number, to_pay, years_since
from peerbench.operators.tables import null_outside


def column(spark, values, type_name="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")


def applied(df, expr):
    return [r["r"] for r in df.select("i", expr.alias("r")).orderBy("i").collect()]


def test_clean_text_golden(spark):
    df = column(spark, ["  Soft_ware  Eng.  ", "##", "A-B  c", "Unknown_Company", "Données²  x"])
    cleaned = df.withColumn("c", clean_text(F.col("v")))
    assert applied(cleaned, empty_to(F.col("c"), "unknown_company")) == [
        "soft_ware eng", "unknown_company", "ab c", "unknown_company", "données² x",
    ]


def test_clean_text_agrees_with_python_patterns(spark):
    rng = random.Random(7)
    assigned = [chr(c) for c in range(0x3100) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["".join(rng.choice(assigned) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(rng.choice("aB _-.\t\n  é") for _ in range(10)) for _ in range(1000)]
    # A NUL cannot be told from a missing character everywhere; leave it out.
    texts = [t.replace("\x00", "") for t in texts]

    def expected(text):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text).strip().lower())

    assert applied(column(spark, texts), clean_text(F.col("v"))) == [expected(t) for t in texts]


@pytest.mark.parametrize(
    "text, value",
    [(" 12 ", 12.0), ("1e5", 100000.0), ("1,000", None), ("", None), ("nan", None), ("1d", None), ("inf", None),
     ("1e999", None), ("-.5", -0.5), ("0x1A", None), ("1_0", None), (None, None), ("+7.", 7.0)],
)
def test_to_number(spark, text, value):
    assert applied(column(spark, [text]), to_number(F.col("v"))) == [value]


def test_to_number_of_numeric_columns(spark):
    assert applied(column(spark, [1.5, float("nan"), None, float("inf"), 1e16], "double"), to_number(F.col("v"))) == [1.5, None, None, None, 1e16]


def test_to_pay_is_exact(spark):
    assert [str(v) for v in applied(column(spark, ["0.1", "1e3", "123456789.12"]), to_pay(F.col("v")))] == ["0.1000", "1000.0000", "123456789.1200"]


def test_year_bounds(spark):
    df = column(spark, [1959, 1960, 2005, 2006, 0, 20165], "int")
    assert applied(df, null_outside(F.col("v"), 1960, 2005)) == [None, 1960, 2005, None, None, None]


def test_experience_clamp(spark):
    df = column(spark, [1930, 1945, 2005, 2010, None], "int")
    assert applied(df, clamp(years_since(F.col("v"), 2005), 0, 60)) == [60, 60, 0, 0, None]


def test_rounding_half_even(spark):
    df = column(spark, [2000.5, 2001.5, 2005.4, None], "double")
    assert applied(df, round_int(F.col("v"))) == [2000, 2002, 2005, None]
    assert applied(column(spark, [0.00005, 0.00015, 1.23456], "double"), round_places(F.col("v"), 4))[0::2] == [0.0, 1.2346]


def test_flag_with_missing_sides(spark):
    rows = [(None, 6, 3), (2, None, None), (2, 6, 3), (3, 6, 3), (1, 6, 3)]
    df = spark.createDataFrame(rows, "v decimal(10,2), s decimal(20,2), n bigint".replace("decimal(10,2)", "int").replace("decimal(20,2)", "int"))
    flags = [r[0] for r in df.select(peer_flag(F.col("v"), F.col("s"), F.col("n"))).collect()]
    assert flags == [2, 2, 2, 1, 3]


def test_default_label(spark):
    assert applied(column(spark, [3, None], "bigint"), default_label(F.col("v"))) == [3, -1]


def test_clean_text_of_every_printable_character(spark):
    """The pattern of plain text drops what the one of all scripts drops."""
    from peerbench.functions.text import JUNK

    texts = [f"A{chr(c)} {chr(c)}b" for c in range(0x20, 0x7F)]
    got = applied(column(spark, texts), clean_text(F.col("v")))
    assert got == [re.sub("  +", " ", re.sub(r"[^a-zA-Z0-9_ ]+", "", t).lower()).strip() for t in texts]
    assert applied(column(spark, [t + "é" for t in texts]), clean_text(F.col("v"))) == [g + "é" for g in got]
    assert len(re.sub(JUNK, "", "".join(map(chr, range(0x20, 0x7F))))) == 64
