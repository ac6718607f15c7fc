"""One query per operator, all over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.catalog.binding import SETTINGS, people_view, people_views
from peerbench.config import COMPANY, EXPERIENCE, JOB, PEER_FLAGS, PEER_LEVELS
from peerbench.functions import clamp, clean_text, to_number, years_since
from peerbench.operators import distribution, kmeans, peers, profile, rank, segments, tables
from peerbench.operators.features import feature_stats, fit_features
from peerbench.operators.impute import impute_median, impute_nearest
from peerbench.operators.quantiles import exact_quantiles
from peerbench.plans import people
from peerbench.sources import add_row_id, drop_index, infer_types, null_tokens, read_people, round_floats, spread, write_people
from peerbench.staging import shared_folder, stage, stage_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Given centroids for the assignment queries: pay in thousands, years of experience.
CENTROIDS = [(10.0, 6.0), (30.0, 8.0), (50.0, 10.0), (70.0, 8.0), (90.0, 11.0)]
RAW_TEXT = people.TEXT
FEATURES = (people.NUMERIC_FEATURES, people.CATEGORICAL_FEATURES)

_steps: dict[tuple[str, str, str], DataFrame] = {}
_micros: dict[tuple[str, str], segments.Clusters] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _step(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """A step that many queries start from, computed and written once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _steps:
        _steps[at] = write(build(), name)
    return _steps[at]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda: stage_parts(spark, (people.clean(view, SETTINGS) for view in people_views(spark, sf_dir)), "cleaned")
    return _step(spark, sf_dir, "cleaned", parts, lambda table, name: table)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: people.derive(people.impute(cleaned(spark, sf_dir), SETTINGS), SETTINGS)
    return _step(spark, sf_dir, "prepared", build)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, "enriched", lambda: people.staged_enrich(prepared(spark, sf_dir)), lambda table, name: table)


def _as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("ctc", F.col("ctc").cast("double")) if "ctc" in df.columns else df


# Sources and cleaning


@query
def people_raw(spark, sf_dir):
    return null_tokens(drop_index(people_view(spark, sf_dir)), RAW_TEXT, SETTINGS.null_tokens)


@query
def people_typed(spark, sf_dir):
    """Column types as inferred from the whole content."""
    raw = null_tokens(people_view(spark, sf_dir), RAW_TEXT, SETTINGS.null_tokens)
    return infer_types(raw).select("row_id", "orgyear", "ctc", "ctc_updated_year")


@query
def people_clean(spark, sf_dir):
    return _as_doubles(people.clean(people_view(spark, sf_dir), SETTINGS))


@query
def clean_documents(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query
def csv_roundtrip(spark, sf_dir):
    """The enriched table written as CSV and read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_people(round_floats(enriched(spark, sf_dir), SETTINGS.decimals), path, compression="gzip")
    back = read_people(spark, path)
    numbers = ["ctc", "Avg_ctc_Co", "Median_ctc_Co_Job"]
    return back.select(
        "row_id", "company_hash", "job_position", COMPANY, JOB, *[to_number(F.col(c)).alias(c) for c in numbers], F.col("Tier").cast("int").alias("Tier")
    )


@query
def csv_quoted_roundtrip(spark, sf_dir):
    """Texts with line breaks, quotes and commas written as CSV and read again."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    quoted = F.concat(F.lit('a "b", c\n'), JOB, F.lit("\n,")).alias("quoted")
    write_people(cleaned(spark, sf_dir).select("row_id", COMPANY, quoted), path)
    return read_people(spark, path)


# Profile


@query
def shape(spark, sf_dir):
    return profile.shape(people_view(spark, sf_dir))


@query
def column_info(spark, sf_dir):
    return profile.column_info(cleaned(spark, sf_dir))


@query
def null_counts(spark, sf_dir):
    return profile.null_counts(cleaned(spark, sf_dir))


@query
def preview(spark, sf_dir):
    return _as_doubles(profile.preview(prepared(spark, sf_dir), 5, "row_id"))


@query
def describe_numeric(spark, sf_dir):
    return round_floats(profile.describe_numeric(cleaned(spark, sf_dir), ["orgyear", "ctc", "ctc_updated_year"]), 4)


@query
def describe_numeric_ranked(spark, sf_dir):
    """Quartiles by the plan for tables of any size."""
    q = F.col("quantiles")
    found = exact_quantiles(prepared(spark, sf_dir), [], "ctc", [0.25, 0.5, 0.75])
    return round_floats(found.select(q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75")), 4)


@query
def describe_categorical(spark, sf_dir):
    return profile.describe_categorical(people_raw(spark, sf_dir), ["company_hash", "email_hash", "job_position"])


@query
def n_unique(spark, sf_dir):
    return profile.n_unique(cleaned(spark, sf_dir), ["email_hash", "company_hash", "job_position", COMPANY, JOB])


@query
def n_repeated(spark, sf_dir):
    return profile.n_repeated(cleaned(spark, sf_dir), "email_hash")


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(people_raw(spark, sf_dir), "job_position")


@query
def top_values(spark, sf_dir):
    return profile.top_values(cleaned(spark, sf_dir), "email_hash", 5)


# Imputation, distinct, derived columns


@query
def impute_median_pay(spark, sf_dir):
    return _as_doubles(impute_median(cleaned(spark, sf_dir), "ctc").select("row_id", "ctc"))


@query
def impute_nearest_year(spark, sf_dir):
    paid = impute_median(cleaned(spark, sf_dir), "ctc")
    filled = impute_nearest(paid, "orgyear", "ctc", SETTINGS.neighbours, "row_id", stage=stage)
    return _as_doubles(filled.select("row_id", "ctc", F.col("orgyear").cast("int").alias("orgyear")))


@query
def duplicate_report(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return tables.removed_rows(rows, tables.drop_duplicate_rows(rows))


@query
def drop_duplicate_rows(spark, sf_dir):
    return _as_doubles(tables.drop_duplicate_rows(cleaned(spark, sf_dir)).select("row_id", "company_hash", "orgyear", "ctc"))


@query
def people_prepared(spark, sf_dir):
    """The whole preparation, from the driver tables on."""
    return _as_doubles(people.prepare(people_view(spark, sf_dir), SETTINGS))


@query
def experience(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_id", "orgyear", EXPERIENCE)


# Peers


@query
def peer_summary_3(spark, sf_dir):
    return peers.peer_summary(prepared(spark, sf_dir), PEER_LEVELS["Co_Job_Exp"], "ctc", "Co_Job_Exp")


@query
def peer_summary_2(spark, sf_dir):
    return peers.peer_summary(prepared(spark, sf_dir), PEER_LEVELS["Co_Job"], "ctc", "Co_Job")


@query
def peer_summary_1(spark, sf_dir):
    return peers.peer_summary(prepared(spark, sf_dir), PEER_LEVELS["Co"], "ctc", "Co")


@query
def peer_summary_ranked(spark, sf_dir):
    """The company summary by the plan for groups of any size."""
    return peers.peer_summary(prepared(spark, sf_dir), PEER_LEVELS["Co"], "ctc", "Co")


def with_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared people, of whom some have no job, some no experience and some no company."""
    missing = lambda col, nth: F.when(F.split("row_id", "-")[2].cast("bigint") % nth != 0, F.col(col)).alias(col)
    return prepared(spark, sf_dir).select("row_id", missing(COMPANY, 11), missing(JOB, 5), missing(EXPERIENCE, 7), "ctc")


@query
def peer_summaries_missing_keys(spark, sf_dir):
    return peers.peer_summaries(with_missing_keys(spark, sf_dir), PEER_LEVELS, "ctc")


@query
def peer_flags_missing_keys(spark, sf_dir):
    """Flags of rows of which some have no group: those are neither above nor below."""
    flagged = peers.attach_peers(with_missing_keys(spark, sf_dir), PEER_LEVELS, "ctc", medians=False)
    return _as_doubles(flagged.select("row_id", "ctc", *PEER_FLAGS))


@query
def drop_incomplete_rows(spark, sf_dir):
    kept = tables.drop_incomplete(with_missing_keys(spark, sf_dir), [COMPANY, JOB, EXPERIENCE])
    return kept.select("row_id", COMPANY, JOB, EXPERIENCE)


@query
def positive_rows(spark, sf_dir):
    """Rows with pay above zero, where every third has none or less."""
    part = F.split("row_id", "-")[2].cast("bigint")
    signed = F.when(part % 3 == 0, F.col("ctc") * 0).when(part % 3 == 1, -F.col("ctc")).otherwise(F.col("ctc"))
    rows = prepared(spark, sf_dir).select("row_id", signed.cast("double").alias("ctc"))
    return tables.positive(rows, "ctc")


@query
def clamped_experience(spark, sf_dir):
    """Years up to 1996, held between 0 and 3: both ends act."""
    years = clamp(years_since(F.col("orgyear"), 1996), 0, 3)
    return prepared(spark, sf_dir).select("row_id", years.cast("int").alias("years"))


@query
def index_dropped(spark, sf_dir):
    """An index column comes in and goes; keys made of the content tell apart what differs."""
    rows = cleaned(spark, sf_dir).select(F.monotonically_increasing_id().cast("string").alias("Unnamed: 0"), "company_hash", "orgyear", JOB)
    keyed = add_row_id(drop_index(rows))
    return keyed.groupBy("company_hash", JOB).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_keys"))


@query
def peer_summaries_grouping_sets(spark, sf_dir):
    return peers.peer_summaries(prepared(spark, sf_dir), PEER_LEVELS, "ctc")


@query
def attach_summary(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    keys = PEER_LEVELS["Co_Job"]
    return _as_doubles(peers.attach_summary(rows.select("row_id", *keys, "ctc"), peers.peer_summary(rows, keys, "ctc", "Co_Job"), keys))


@query
def peer_flags(spark, sf_dir):
    """Flags alone need no medians: one aggregation of the rows and one join."""
    flagged = peers.attach_peers(prepared(spark, sf_dir), PEER_LEVELS, "ctc", medians=False)
    return _as_doubles(flagged.select("row_id", "ctc", *PEER_FLAGS))


@query
def flag_counts(spark, sf_dir):
    return peers.flag_counts(peers.attach_peers(prepared(spark, sf_dir), PEER_LEVELS, "ctc", medians=False))


@query
def people_enriched(spark, sf_dir):
    """Everything but the segments, with fractions rounded as for the written table."""
    return round_floats(enriched(spark, sf_dir), SETTINGS.decimals)


@query
def event_flags(spark, sf_dir):
    """The generic peer operator on another table: events against their type and user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.col("value").cast("decimal(20,4)"))
    levels = {"user": ["event_type", "user_id"], "type": ["event_type"]}
    flagged = peers.attach_peers(events, levels, "value", flags={"by_user": "user", "by_type": "type"}, medians=False)
    return flagged.select("event_id", "by_user", "by_type")


# Ranked answers


def _answer(name: str) -> Query:
    def run(spark, sf_dir):
        return _as_doubles(people.answers(enriched(spark, sf_dir), SETTINGS, [name])[name])

    run.__name__ = name
    return query(run)


for _name in (
    "top_tier", "bottom_tier", "role_top_per_company", "role_bottom_per_company",
    "job_experience_top", "top_companies", "top_jobs_per_company",
):
    _answer(_name)


@query
def sorted_people(spark, sf_dir):
    rows = enriched(spark, sf_dir).select(*people.ANSWER)
    return _as_doubles(rank.sort_rows(rows, "ctc", ties=["row_id"]))


@query
def role_matches(spark, sf_dir):
    return tables.match_text(enriched(spark, sf_dir), JOB, SETTINGS.role_pattern).select("row_id", JOB)


# Distribution tables


@query
def histogram_experience(spark, sf_dir):
    return round_floats(distribution.histogram(prepared(spark, sf_dir), EXPERIENCE), 6)


@query
def histogram_pay_log(spark, sf_dir):
    return round_floats(distribution.histogram(prepared(spark, sf_dir), "ctc", log=True), 6)


@query
def histogram_events(spark, sf_dir):
    return round_floats(distribution.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "value"), 6)


@query
def density_experience(spark, sf_dir):
    return round_floats(distribution.density(prepared(spark, sf_dir), EXPERIENCE), 8)


@query
def density_pay_log(spark, sf_dir):
    return round_floats(distribution.density(prepared(spark, sf_dir), "ctc", log=True), 8)


@query
def bar_counts(spark, sf_dir):
    return distribution.bar_counts(prepared(spark, sf_dir), [COMPANY, JOB], SETTINGS.top_categories)


@query
def top_category_rows(spark, sf_dir):
    return distribution.restrict_to_top(prepared(spark, sf_dir), COMPANY, SETTINGS.top_categories).select("row_id", COMPANY)


@query
def sample_rows(spark, sf_dir):
    return distribution.sample_rows(prepared(spark, sf_dir).select("row_id", COMPANY), SETTINGS.sample_size, SETTINGS.seed, "row_id")


@query
def scatter_points(spark, sf_dir):
    points = distribution.scatter_points(prepared(spark, sf_dir), EXPERIENCE, "ctc", SETTINGS.scatter_cap, SETTINGS.seed, "row_id")
    return _as_doubles(points)


@query
def scatter_points_all(spark, sf_dir):
    return _as_doubles(distribution.scatter_points(prepared(spark, sf_dir), EXPERIENCE, "ctc", None, SETTINGS.seed, "row_id"))


@query
def scatter_cells(spark, sf_dir):
    return round_floats(distribution.scatter_cells(prepared(spark, sf_dir), EXPERIENCE, "ctc"), 4)


@query
def density_updated_year(spark, sf_dir):
    return round_floats(distribution.density(prepared(spark, sf_dir), "ctc_updated_year"), 8)


@query
def histogram_updated_year(spark, sf_dir):
    return round_floats(distribution.histogram(prepared(spark, sf_dir), "ctc_updated_year"), 6)


# Features and segments


@query
def feature_columns(spark, sf_dir):
    """Non-zeros, mean and deviation of every column of the scaled feature vectors."""
    rows = tables.drop_incomplete(prepared(spark, sf_dir), [*FEATURES[0], *FEATURES[1]])
    return round_floats(feature_stats(fit_features(rows, *FEATURES), rows), 6)


@query
def elbow(spark, sf_dir):
    return segments.elbow(
        prepared(spark, sf_dir), *FEATURES, SETTINGS.sweep, key="row_id", restarts=SETTINGS.restarts, seed=SETTINGS.seed
    )


def _kmeans(spark, sf_dir):
    fit = lambda: segments.kmeans_segments(
        prepared(spark, sf_dir), *FEATURES, SETTINGS.segments, key="row_id", restarts=SETTINGS.restarts, seed=SETTINGS.seed
    )
    return _step(spark, sf_dir, "kmeans", fit)


@query
def kmeans_segments(spark, sf_dir):
    return _kmeans(spark, sf_dir).select("row_id", "KMeans_Cluster")


@query
def kmeans_checks(spark, sf_dir):
    """The fit looked at anew: centres are rebuilt from the labels. They lie within ``tol`` of those that gave the
    labels, so a row's own centre is farther than the nearest by no more than that lets it be."""
    rows = _kmeans(spark, sf_dir)
    space = fit_features(rows, *FEATURES)
    points = kmeans.lay_out(space, rows, "row_id", labels=[F.col("KMeans_Cluster")])
    again = kmeans.gaps(points, kmeans.from_labels(points, [SETTINGS.segments]))
    tol = 1e-4
    near = F.col("own") - F.col("least") <= 4 * tol * F.sqrt("own") + 4 * tol * tol
    return again.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("label").cast("int").alias("n_segments"),
        F.count_if(~F.col("label").between(0, SETTINGS.segments - 1)).alias("n_outside"),
        (F.count_if(~near) == 0).alias("at_nearest_centre"),
    )


def _given_start(k: int):
    return F.col(EXPERIENCE) % k


def _kmeans_rounds(spark, sf_dir, **options):
    """Three rounds from given labels."""
    found = segments.kmeans_segments(
        prepared(spark, sf_dir), *FEATURES, SETTINGS.segments, key="row_id", max_iter=3, start=_given_start(SETTINGS.segments), **options
    )
    return found.select("row_id", "KMeans_Cluster")


@query
def kmeans_rounds(spark, sf_dir):
    return _kmeans_rounds(spark, sf_dir)


@query
def kmeans_segments_tables(spark, sf_dir):
    """The same rounds with the centres kept as tables."""
    return _kmeans_rounds(spark, sf_dir, max_cells=0)


@query
def elbow_rounds(spark, sf_dir):
    """The cost sweep after three rounds from given labels."""
    sweep = segments.elbow(prepared(spark, sf_dir), *FEATURES, [2, 3, 4, 7], key="row_id", max_iter=3, start=_given_start)
    return round_floats(sweep, 2)


def _micro(spark, sf_dir):
    """The micro-clusters, fitted once per session and folder; their labelled rows are written."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _micros:
        micro = segments.micro_clusters(
            prepared(spark, sf_dir), *FEATURES, key="row_id", n=SETTINGS.micro_clusters, seed=SETTINGS.seed
        )
        _micros[at] = replace(micro, labelled=stage(micro.labelled, "micro"))
    return _micros[at]


def _hierarchical(spark, sf_dir):
    return segments.hierarchical_segments(
        prepared(spark, sf_dir), *FEATURES, SETTINGS.segments, key="row_id", micro=_micro(spark, sf_dir)
    )


@query
def hierarchical_segments(spark, sf_dir):
    return _hierarchical(spark, sf_dir).select("row_id", "Hierarchical_Cluster")


@query
def hierarchical_checks(spark, sf_dir):
    label = F.col("Hierarchical_Cluster")
    return _hierarchical(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).cast("int").alias("n_segments"), F.count_if(label == -1).alias("n_unassigned")
    )


@query
def merge_tree(spark, sf_dir):
    return segments.merge_tree(spark, _micro(spark, sf_dir))


@query
def merge_tree_checks(spark, sf_dir):
    """The whole tree: heights never fall, and the last merge holds every row."""
    tree = segments.merge_tree(spark, _micro(spark, sf_dir), last=None)
    in_order = F.array_sort(F.collect_list(F.struct("step", "height")))
    # At most as many merges as micro-clusters, whatever the number of rows.
    rises = F.forall(F.sequence(F.lit(1), F.size(in_order) - 1), lambda i: in_order[i]["height"] >= in_order[i - 1]["height"] - 1e-9)
    return tree.agg(rises.alias("heights_rise"), F.max("size").alias("n_rows"))


def _job_leaves(spark, sf_dir):
    """One leaf for each job, by pay, experience and job."""
    return segments.group_leaves(prepared(spark, sf_dir), FEATURES[0], [JOB], key="row_id", by=JOB)


@query
def merge_tree_jobs(spark, sf_dir):
    """The whole Ward tree over one centre per job."""
    return round_floats(segments.merge_tree(spark, _job_leaves(spark, sf_dir), last=None), 6)


@query
def hierarchical_jobs(spark, sf_dir):
    """All rows with the label of the tree over jobs, cut into five."""
    found = segments.hierarchical_segments(
        prepared(spark, sf_dir), FEATURES[0], [JOB], SETTINGS.segments, key="row_id", micro=_job_leaves(spark, sf_dir)
    )
    return found.select("row_id", "Hierarchical_Cluster")


def _assigned(spark, sf_dir):
    """Rows with the number of the nearest given centroid; unknown companies stay unassigned."""
    rows = prepared(spark, sf_dir)
    coordinates = [F.col("ctc").cast("double") / 1000, F.col(EXPERIENCE).cast("double")]
    labels = segments.assign_to_centroids(rows.where(F.col(COMPANY) != "unknown_company"), coordinates, CENTROIDS, "segment")
    return tables.attach_labels(rows, labels, ["row_id", "ctc"], "segment")


@query
def assign_people(spark, sf_dir):
    return _assigned(spark, sf_dir).select("row_id", "segment")


@query
def assign_embeddings(spark, sf_dir):
    """Vectors of an array column against five of their own number."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centres = [r["embedding"] for r in vectors.orderBy("vec_id").limit(5).collect()]
    return segments.assign_to_centroids(vectors, F.col("embedding"), centres, "segment").select("vec_id", "segment")


@query
def segment_means(spark, sf_dir):
    return round_floats(segments.cluster_means(_assigned(spark, sf_dir), "segment", people.NUMERIC_FEATURES), 4)


@query
def segment_sizes(spark, sf_dir):
    return segments.cluster_sizes(_assigned(spark, sf_dir), "segment")


@query
def segment_top_companies(spark, sf_dir):
    return profile.top_values_per_group(tables.assigned(_assigned(spark, sf_dir), "segment"), "segment", COMPANY, 5)


@query
def segment_top_jobs(spark, sf_dir):
    return profile.top_values_per_group(tables.assigned(_assigned(spark, sf_dir), "segment"), "segment", JOB, 5)
