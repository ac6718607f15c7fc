import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from peerbench.catalog import queries
from peerbench.catalog.binding import SETTINGS, people_view
from peerbench.config import PEER_LEVELS, Settings
from peerbench.functions import clean_text
from peerbench.operators import peers, rank, tables
from peerbench.operators.impute import impute_nearest
from peerbench.operators.quantiles import exact_quantiles
from peerbench.plans import people
from peerbench.sources import read_people
from peerbench.staging import stage

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def assert_scalable(text):
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, bad


@pytest.fixture(scope="module")
def prepared(spark):
    return queries.prepared(spark, SMALL)


def test_cleaning_is_one_stage_of_native_expressions(spark):
    raw = stage(people_view(spark, SMALL), "raw")
    text = plan(people.clean(raw, SETTINGS))
    assert_scalable(text)
    assert "Exchange" not in text


def test_flags_aggregate_rows_once_and_join_once(prepared):
    text = plan(peers.attach_peers(prepared, PEER_LEVELS, "ctc", medians=False))
    assert_scalable(text)
    assert "Window" not in text


def test_summaries_do_not_loop_over_pairs(prepared):
    assert_scalable(plan(people.enrich(prepared)))
    assert_scalable(plan(peers.peer_summaries(prepared, PEER_LEVELS, "ctc")))


def test_nearest_search_has_no_join_of_pairs(spark):
    cleaned = queries.cleaned(spark, SMALL)
    text = plan(impute_nearest(cleaned, "orgyear", "ctc", 5, "row_id", stretch=500, stage=lambda df, name: df))
    assert_scalable(text)
    # Donors of one value are cut to k before they are shuffled.
    assert "WindowGroupLimit" in text


def test_ranked_answers_are_cut_before_the_shuffle(prepared):
    assert "TakeOrderedAndProject" in plan(rank.top_rows(prepared, F.col("ctc") > 0, "ctc", 10, ties=["row_id"]))
    text = plan(rank.top_per_group(prepared, F.col("ctc") > 0, "company_hash", "ctc", 10, ties=["row_id"]))
    assert text.index("WindowGroupLimit") > 0 and text.count("WindowGroupLimit") >= 2


def test_filters_and_columns_reach_the_scan(prepared):
    text = plan(rank.top_rows(prepared.select("row_id", "ctc", "orgyear"), F.col("orgyear") == 2000, "ctc", 10, ties=["row_id"]))
    assert "EqualTo(orgyear,2000)" in text
    assert "job_position" not in text


def test_hot_groups_are_split_in_the_join(spark, tmp_path):
    """A peer group with a third of all rows does not stay in one task of the join."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    n = F.col("id")
    rows = spark.range(120_000, numPartitions=8).select(
        n.cast("string").alias("row_id"), F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), n % 1000)).alias("a"),
        F.when(n % 3 == 0, "j").otherwise(F.concat(F.lit("j"), n % 7)).alias("b"), (n % 100).cast("decimal(20,4)").alias("pay"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = peers.attach_peers(
            spark.read.parquet(str(tmp_path / "rows")), {"fine": ["a", "b"], "coarse": ["a"]}, "pay", flags={"f": "fine"}, medians=False
        )
        assert len(found.collect()) == 120_000
        assert "skew=true" in plan(found)
    finally:
        for key in small:
            spark.conf.unset(key)


def test_whole_plan_from_csv(spark, tmp_path):
    """Raw CSV with an index column in; enriched CSV and all report tables out."""
    raw = people_view(spark, SMALL).drop("row_id").withColumn("Unnamed: 0", F.monotonically_increasing_id())
    raw.select("Unnamed: 0", *people.TEXT).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(str(tmp_path / "raw"))
    settings = Settings(
        as_of_year=2005, role_pattern="ring|gear", job="small ring", experience=5, sample_size=500, restarts=1, sweep=(2, 3), micro_clusters=12
    )
    reports = people.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), settings)
    out = read_people(spark, str(tmp_path / "out"))
    # The same people as the view with its own key gives.
    assert out.count() == queries.prepared(spark, SMALL).drop("row_id").distinct().count()
    added = [f"{f}_ctc_{s}" for s in PEER_LEVELS for f in ("Avg", "Median", "Max", "Min")] + [f"Count_{s}" for s in PEER_LEVELS]
    assert set(out.columns) == {
        "row_id", *people.TEXT, *people.CATEGORICAL_FEATURES, "Years_of_Experience", *added,
        "Designation", "Class", "Tier", "KMeans_Cluster", "Hierarchical_Cluster",
    }
    assert {r[0] for r in out.select("KMeans_Cluster").distinct().collect()} == {str(i) for i in range(5)}
    assert out.where("orgyear is null or ctc is null").count() == 0
    tiers = {r["Tier"]: r["n"] for r in reports["flag_counts"].groupBy("Tier").agg(F.sum("n").alias("n")).collect()}
    want = {r["Tier"]: r["count"] for r in out.groupBy(F.col("Tier").cast("int").alias("Tier")).count().collect()}
    assert tiers == want
    for name, table in reports.items():
        assert table.count() > 0, name
    missing = lambda name: {r["column"]: r["missing"] for r in reports[name].collect()}
    assert missing("missing_before")["ctc"] > 0 and missing("missing_before")["orgyear"] > 0
    assert missing("missing_after")["ctc"] == missing("missing_after")["orgyear"] == 0
    removed = reports["removed_rows"].first()
    assert removed["rows_after"] == out.count() and removed["rows_before"] - removed["rows_after"] == removed["rows_removed"] > 0
    assert reports["describe_experience"].first()["count"] == out.count()
    for label in ("KMeans_Cluster", "Hierarchical_Cluster"):
        sizes = {r[label]: r["size"] for r in reports[f"segment_labels_{label}"].collect()}
        assert sizes == {int(r[label]): r["count"] for r in out.groupBy(label).count().collect()}
    assert [r["k"] for r in reports["elbow"].collect()] == [2, 3] and reports["merge_tree"].count() == 11


def test_levels_start_from_counted_values_that_are_written_once(prepared):
    for found in (peers.peer_summaries(prepared, PEER_LEVELS, "ctc"), peers.peer_table(prepared, PEER_LEVELS, "ctc")):
        files = {path.rsplit("/", 2)[1].split("-")[0] for path in found.inputFiles()}
        assert files == {"counted"}


def test_one_answer_does_not_begin_the_summaries_of_others(spark, prepared, monkeypatch):
    monkeypatch.setattr(people, "peer_summary", lambda *args: pytest.fail("not asked for"))
    assert list(people.answers(people.enrich(prepared, medians=False), SETTINGS, ["top_tier"])) == ["top_tier"]


def test_rows_without_copies_are_not_shuffled(spark, prepared):
    rows = tables.drop_duplicate_rows(prepared)
    assert rows.count() == prepared.count()
    text = plan(rows)
    # the hashes, their bitmap, and the rows that share a bit
    assert "Union" in text and "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") <= 4


def test_values_are_counted_once_for_their_ranks(spark, prepared):
    found = exact_quantiles(prepared, [], "ctc", [0.5])
    found.collect()
    assert "ReusedExchange" in plan(found)


def test_donors_are_sorted_without_a_comparator_in_lambda_form(spark):
    text = plan(impute_nearest(queries.cleaned(spark, SMALL), "orgyear", "ctc", 5, "row_id", stage=lambda df, name: df))
    assert "sort_array(" in text and "array_sort(" not in text


def test_plain_text_needs_no_table_of_spaces(spark):
    rows = spark.createDataFrame([(" Ab#  c-d ",), ("a\u00a0\u2003b\tc",), (None,)], "v string")
    found = rows.select(clean_text(F.col("v")).alias("c"))
    assert [r["c"] for r in found.collect()] == ["ab cd", "a b c", None]
    assert "RLIKE(v" in plan(found)


def test_written_steps_leave_no_shuffle_files(spark, prepared):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = lambda: {n for n in kept.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = listed()
    stage(prepared.repartition(3).groupBy("company_hash").count(), "counts")
    queries.people.staged_enrich(prepared)
    # the files of single collected figures stay
    assert sum(os.path.getsize(n) for n in listed() - before) < 10_000
