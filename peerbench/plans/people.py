"""The end-to-end plans: prepare, compare with peers, answer, segment, write.

Each step is DataFrame to DataFrame. Steps that several later ones read are written to the
shared folder (``stage``), so they are computed once and a lost executor costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.config import (
    COMPANY, EMPTY_COMPANY, EMPTY_JOB, EXPERIENCE, JOB, MISSING_COMPANY, MISSING_JOB, PEER_LEVELS, Settings,
)
from peerbench.functions import clamp, clean_text, empty_to, round_int, to_number, to_pay, years_since
from peerbench.operators import distribution, profile as prof, rank, segments
from peerbench.operators.impute import impute_median, impute_nearest
from peerbench.operators.peers import attach_peers, flag_counts, peer_summary, staged_peers
from peerbench.operators.tables import drop_duplicate_rows, fill_missing, match_text, null_outside, removed_rows
from peerbench.sources import add_row_id, drop_index, infer_types, null_tokens, read_people, round_floats, write_people
from peerbench.staging import stage as stage_table

Stage = Callable[[DataFrame, str], DataFrame]

TEXT = ["company_hash", "email_hash", "orgyear", "ctc", "job_position", "ctc_updated_year"]
NUMERIC_FEATURES = ["ctc", EXPERIENCE]
CATEGORICAL_FEATURES = [COMPANY, JOB]
ANSWER = ["row_id", "email_hash", COMPANY, JOB, EXPERIENCE, "ctc", "Designation", "Class", "Tier"]


def clean(raw: DataFrame, settings: Settings) -> DataFrame:
    """Missing tokens, placeholders, normalised text, parsed numbers, invalid years to missing."""
    rows = null_tokens(drop_index(raw), [c for c in TEXT if c in raw.columns], settings.null_tokens)
    if "row_id" not in rows.columns:
        rows = add_row_id(rows)
    rows = fill_missing(rows, {"company_hash": MISSING_COMPANY, "job_position": MISSING_JOB})
    parsed = rows.withColumns(
        {
            COMPANY: clean_text(F.col("company_hash")),
            JOB: clean_text(F.col("job_position")),
            "ctc": to_pay(F.col("ctc")),
            "ctc_updated_year": to_number(F.col("ctc_updated_year")),
            "orgyear": to_number(F.col("orgyear")),
        }
    )
    # A second projection, so that what is tested and then returned is computed once.
    return parsed.withColumns(
        {
            COMPANY: empty_to(F.col(COMPANY), EMPTY_COMPANY),
            JOB: empty_to(F.col(JOB), EMPTY_JOB),
            "orgyear": null_outside(F.col("orgyear"), settings.min_year, settings.as_of_year),
        }
    )


def impute(cleaned: DataFrame, settings: Settings, stage: Stage = stage_table) -> DataFrame:
    """Missing pay from the median, then missing years from the rows nearest in pay."""
    paid = impute_median(cleaned, "ctc", stage=stage)
    filled = impute_nearest(paid, "orgyear", "ctc", settings.neighbours, "row_id", stage=stage)
    return filled.withColumn("orgyear", round_int(F.col("orgyear")))


def derive(imputed: DataFrame, settings: Settings) -> DataFrame:
    """Duplicates out (after imputation, so that copies have counted as donors), experience in."""
    experience = clamp(years_since(F.col("orgyear"), settings.as_of_year), 0, settings.max_experience)
    return drop_duplicate_rows(imputed).withColumn(EXPERIENCE, experience)


def prepare(raw: DataFrame, settings: Settings, stage: Stage = stage_table) -> DataFrame:
    return derive(impute(stage(clean(raw, settings), "cleaned"), settings, stage), settings)


def enrich(prepared: DataFrame, *, medians: bool = True) -> DataFrame:
    """Peer summaries of the three levels and the flags Designation, Class and Tier."""
    return attach_peers(prepared, PEER_LEVELS, "ctc", medians=medians)


def staged_enrich(prepared: DataFrame) -> DataFrame:
    """``enrich``, written part by part."""
    return staged_peers(prepared, PEER_LEVELS, "ctc", "enriched")


def answers(enriched: DataFrame, settings: Settings, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The ranked questions, by name; all, or those in ``names``, of which no other's summaries are begun."""
    rows = enriched.select(*ANSWER)
    in_role = match_text(rows, JOB, settings.role_pattern)
    same_job = (F.col(JOB) == settings.job) & (F.col(EXPERIENCE) == settings.experience)
    companies = lambda: peer_summary(enriched, PEER_LEVELS["Co"], "ctc", "Co")
    jobs = lambda: peer_summary(enriched, PEER_LEVELS["Co_Job"], "ctc", "Co_Job")
    by_id = {"ties": ["row_id"]}
    found = {
        "flag_counts": lambda: flag_counts(enriched),
        "top_tier": lambda: rank.top_rows(rows, F.col("Tier") == 1, "ctc", 10, **by_id),
        "bottom_tier": lambda: rank.top_rows(rows, F.col("Tier") == 3, "ctc", 10, descending=False, **by_id),
        "role_top_per_company": lambda: rank.top_per_group(in_role, F.col("Class") == 1, COMPANY, "ctc", 10, **by_id),
        "role_bottom_per_company": lambda: rank.top_per_group(in_role, F.col("Class") == 3, COMPANY, "ctc", 10, descending=False, **by_id),
        "job_experience_top": lambda: rank.top_per_group(rows, same_job & (F.col("Designation") == 1), COMPANY, "ctc", 10, **by_id),
        "top_companies": lambda: rank.top_groups(companies(), "Avg_ctc_Co", "Count_Co", settings.min_group, 10, ties=[COMPANY]).select(
            COMPANY, "Avg_ctc_Co", "Count_Co"
        ),
        "top_jobs_per_company": lambda: rank.top_groups_per(
            jobs(), COMPANY, "Avg_ctc_Co_Job", "Count_Co_Job", settings.min_group, 2, ties=[JOB]
        ).select(COMPANY, JOB, "Avg_ctc_Co_Job", "Count_Co_Job"),
    }
    return {name: found[name]() for name in (found if names is None else names)}


def profile(raw: DataFrame, settings: Settings, stage: Stage = stage_table) -> dict[str, DataFrame]:
    """The tables of a first look at the raw data."""
    typed = stage(infer_types(null_tokens(raw, [c for c in TEXT if c in raw.columns], settings.null_tokens)), "typed")
    text = [c for c, t in typed.dtypes if t == "string"]
    numbers = [c for c, t in typed.dtypes if t in ("bigint", "double")]
    ids = [c for c in ("email_hash", "company_hash", "job_position") if c in text]
    tables = {
        "shape": prof.shape(typed),
        "column_info": prof.column_info(typed),
        "null_counts": prof.null_counts(typed),
        "n_unique": prof.n_unique(typed, ids),
        "describe_categorical": prof.describe_categorical(typed, text),
        "repeated_emails": prof.n_repeated(typed, "email_hash"),
    }
    if numbers:
        tables["describe_numeric"] = prof.describe_numeric(typed, numbers)
    return tables | {f"top_{c}": prof.top_values(typed, c, 5) for c in ids}


def distributions(prepared: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The tables behind the plots of the prepared data; pay is on a logarithmic scale."""
    tables = {}
    for col, log in (("ctc", True), (EXPERIENCE, False), ("ctc_updated_year", False)):
        tables[f"histogram_{col}"] = distribution.histogram(prepared, col, log=log)
        tables[f"density_{col}"] = distribution.density(prepared, col, log=log)
    tables["top_categories"] = distribution.bar_counts(prepared, CATEGORICAL_FEATURES, settings.top_categories)
    tables["scatter_cells"] = distribution.scatter_cells(prepared, EXPERIENCE, "ctc")
    tables["scatter"] = distribution.scatter_points(prepared, EXPERIENCE, "ctc", settings.scatter_cap, settings.seed, "row_id")
    return tables


@dataclass(frozen=True)
class Segmented:
    rows: DataFrame
    elbow: DataFrame
    merge_tree: DataFrame
    profile: dict[str, DataFrame]


def segment(enriched: DataFrame, settings: Settings, stage: Stage = stage_table) -> Segmented:
    """Both segmentations as columns of the rows, the cost sweep, the merge tree and the profiles."""
    features = (NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    sweep = segments.elbow(
        enriched, *features, settings.sweep, key="row_id", sample_size=settings.sample_size, restarts=settings.restarts, seed=settings.seed, stage=stage
    )
    found = segments.kmeans_clusters(
        enriched, *features, settings.segments, key="row_id", restarts=settings.restarts, seed=settings.seed, stage=stage
    )
    labelled = stage(found.labelled, "labelled")
    micro = segments.micro_clusters(labelled, *features, key="row_id", n=settings.micro_clusters, seed=settings.seed, stage=stage)
    both = stage(
        segments.hierarchical_segments(labelled, *features, settings.segments, key="row_id", micro=micro), "segmented"
    )
    tree = segments.merge_tree(enriched.sparkSession, micro)
    profiles = segments.segment_profile(both, "KMeans_Cluster", *features)
    # how many rows have each label, those without one (-1) too
    profiles |= {f"labels_{label}": segments.cluster_sizes(both, label) for label in ("KMeans_Cluster", "Hierarchical_Cluster")}
    profiles |= {"fit": segments.fit_facts(enriched.sparkSession, found)}
    return Segmented(both, sweep, tree, profiles)


def run(spark: SparkSession, source: str, target: str, settings: Settings, *, format: str = "csv") -> dict[str, DataFrame]:
    """Read raw people, write the enriched table, and return all report tables by name."""
    raw = stage_table(drop_index(read_people(spark, source, format=format)), "raw")
    cleaned = stage_table(clean(raw, settings), "cleaned")
    imputed = stage_table(impute(cleaned, settings), "imputed")
    prepared = stage_table(derive(imputed, settings), "prepared")
    enriched = staged_enrich(prepared)
    segmented = segment(enriched, settings)
    write_people(round_floats(segmented.rows, settings.decimals), target, format=format)
    reports = profile(drop_index(raw), settings) | distributions(prepared, settings) | answers(enriched, settings)
    reports |= {
        "missing_before": prof.null_counts(cleaned),
        "missing_after": prof.null_counts(imputed),
        "n_unique_cleaned": prof.n_unique(cleaned, [COMPANY, JOB]),
        "removed_rows": removed_rows(imputed, prepared),
        "describe_experience": prof.describe_numeric(prepared, [EXPERIENCE]),
    }
    reports |= {"elbow": segmented.elbow, "merge_tree": segmented.merge_tree}
    return reports | {f"segment_{name}": table for name, table in segmented.profile.items()}
