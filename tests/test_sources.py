from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from peerbench.sources import add_row_id, drop_index, infer_types, null_tokens, read_people, round_floats, spread, write_people
from peerbench.staging import shared_folder, stage


def test_csv_with_index_quotes_and_spaces(spark, tmp_path):
    text = ',company_hash,job_position\n0," a ""b"", c ",NA\n1,,"x\\y"\n'
    (tmp_path / "raw.csv").write_text(text)
    raw = read_people(spark, str(tmp_path / "raw.csv"))
    assert raw.columns == ["_c0", "company_hash", "job_position"]
    rows = null_tokens(drop_index(raw), ["company_hash", "job_position"], ["", "NA"])
    assert [tuple(r) for r in rows.collect()] == [(' a "b", c ', None), (None, "x\\y")]


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('a,b\n"x\ny",1\n')
    assert [tuple(r) for r in read_people(spark, str(tmp_path / "raw.csv")).collect()] == [("x\ny", "1")]


def test_split_reading_refuses_what_it_would_break(spark, tmp_path):
    for i, text in enumerate(('a,b\n"x\ny",1\n', "a,b\n1\n", "a,b\n1,2,3\n")):
        (tmp_path / f"{i}.csv").write_text(text)
        df = read_people(spark, str(tmp_path / f"{i}.csv"), multiline=False)
        for some in (df, df.select("a")):
            with pytest.raises(Exception, match="(?i)malformed"):
                some.collect()
    (tmp_path / "good.csv").write_text('a,b\n"x ""q"", z",\n2,3\n')
    assert [tuple(r) for r in read_people(spark, str(tmp_path / "good.csv"), multiline=False).collect()] == [('x "q", z', None), ("2", "3")]


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, format):
    df = spark.createDataFrame([(' a "b", c ', "1.5"), (None, "2")], "t string, n string")
    write_people(df, str(tmp_path / "out"), format=format)
    back = read_people(spark, str(tmp_path / "out"), format=format)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_index_column_is_dropped_by_either_name(spark):
    df = spark.createDataFrame([(0, "x")], ["Unnamed: 0", "v"])
    assert drop_index(df).columns == ["v"] and drop_index(drop_index(df)).columns == ["v"]


def test_row_id_is_a_key_of_the_content(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("a", ""), ("a=b", "c")], "x string, y string")
    ids = [r["row_id"] for r in add_row_id(df).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4
    assert ids == [r["row_id"] for r in add_row_id(df).collect()]


def test_types_from_whole_columns(spark):
    rows = [("1", "1", "1.5", "x", None), ("-2", None, "2", "3", None)]
    typed = infer_types(spark.createDataFrame(rows, "whole string, gaps string, part string, text string, none string"))
    assert dict(typed.dtypes) == {"whole": "bigint", "gaps": "double", "part": "double", "text": "string", "none": "double"}
    assert typed.agg(F.sum("whole"), F.sum("part")).first()[:] == (-1, 3.5)


def test_fractions_are_rounded_and_the_rest_left(spark):
    df = spark.createDataFrame([(1.23456, 7, "t")], "d double, i int, s string").withColumn("p", F.lit("2.00015").cast("decimal(20,5)"))
    row = round_floats(df, 4).first()
    assert (row["d"], row["i"], row["s"]) == (1.2346, 7, "t") and row["p"] in (2.0001, 2.0002)


def test_stage_keeps_rows_and_ends_lineage(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    copy = stage(df, "t")
    assert copy.exceptAll(df).count() == 0 and copy.count() == 100
    assert copy.inputFiles() and all(shared_folder(spark) in path for path in copy.inputFiles())


def session(master, settings):
    """What the choice of folder reads of a session; the real setting is fixed once a context runs."""
    context = SimpleNamespace(master=master, getConf=lambda: settings, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=settings, sparkContext=context)


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def test_shared_folder_is_the_one_the_session_names():
    named = Conf({"spark.checkpoint.dir": "hdfs://shared/steps"})
    assert shared_folder(session("yarn", named)) == shared_folder(session("local[2]", named)) == "hdfs://shared/steps"
    with pytest.raises(ValueError):
        shared_folder(session("yarn", Conf()))


def test_spread_only_where_splits_are_few(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(4 * cores).write.parquet(str(tmp_path / "many"))
    assert spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == cores
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 * 2**20))
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert many.rdd.getNumPartitions() >= cores and spread(many) is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_compressed_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x", y'), (" c ", None)], "t string, u string")
    write_people(df, str(tmp_path / "out"), compression="gzip")
    parts = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.endswith(".csv.gz") for p in parts)
    assert sorted(map(tuple, read_people(spark, str(tmp_path / "out")).collect())) == [(" c ", None), ("a\nb", 'say "x", y')]


def test_stage_packs_its_tables_well(spark):
    assert all(".zstd." in path for path in stage(spark.range(10), "t").inputFiles())
