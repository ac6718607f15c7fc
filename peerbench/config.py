"""Every tunable of the engine in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that results depend on.
MISSING_COMPANY = "Unknown_Company"
MISSING_JOB = "Unknown_Position"
EMPTY_COMPANY = "unknown_company"
EMPTY_JOB = "unknown_position"
UNASSIGNED = -1

COMPANY = "Company_hash_Cleaned"
JOB = "Job_position_Cleaned"
EXPERIENCE = "Years_of_Experience"

# Peer levels, finest first: output suffix -> grouping keys.
PEER_LEVELS: dict[str, list[str]] = {
    "Co_Job_Exp": [COMPANY, JOB, EXPERIENCE],
    "Co_Job": [COMPANY, JOB],
    "Co": [COMPANY],
}
# Flag column -> the peer level whose average it compares with.
PEER_FLAGS: dict[str, str] = {"Designation": "Co_Job_Exp", "Class": "Co_Job", "Tier": "Co"}


@dataclass(frozen=True)
class Settings:
    """Parameters of the people plan; only the year has no default."""

    as_of_year: int
    min_year: int = 1960
    max_experience: int = 60
    neighbours: int = 5
    min_group: int = 10
    sample_size: int | None = None  # rows of the cost sweep; None: all
    scatter_cap: int | None = None  # rows of the scatter; None: all
    top_categories: int = 20
    segments: int = 5
    sweep: tuple[int, ...] = tuple(range(2, 11))
    restarts: int = 10
    micro_clusters: int = 100
    seed: int = 42
    decimals: int = 4
    role_pattern: str = "data scientist|data science"
    job: str = "software engineer"
    experience: int = 5
    null_tokens: tuple[str, ...] = field(
        # The text tokens a CSV reader treats as missing.
        default=(
            "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
        )
    )
