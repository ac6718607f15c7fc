"""The same results in plain SQL, written for DuckDB over the driver tables."""

from __future__ import annotations

from peerbench.catalog.binding import SETTINGS
from peerbench.catalog.queries import CENTROIDS

# As in functions.text, in the notation of DuckDB's patterns.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CO, JOB, EXP = '"Company_hash_Cleaned"', '"Job_position_Cleaned"', '"Years_of_Experience"'


def _present(col: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in SETTINGS.null_tokens)
    return f"CASE WHEN {col} IN ({tokens}) THEN NULL ELSE {col} END"


def _cleaned_text(col: str) -> str:
    kept = rf"lower(regexp_replace({col}, '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g'))"
    return f"trim(regexp_replace({kept}, '[{SPACE}]+', ' ', 'g'))"


def _number(col: str) -> str:
    plain = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"CASE WHEN regexp_matches({col}, '{plain}') THEN TRY_CAST({col} AS DOUBLE) END"


def _rounded(expr: str, places: int) -> str:
    factor = f"1e{places}"
    return f"round_even(({expr}) * {factor}, 0) / {factor}"


STEPS: dict[str, str] = {
    "bound": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
               concat('cust-', o_custkey) AS email_hash,
               CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN ' ## ' ELSE s_name END AS company_hash,
               CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN l_orderkey % 79 = 0 THEN '?!'
                    WHEN l_linenumber = 1 THEN concat(' ', upper(p_name)) ELSE replace(p_name, ' ', '   ') END AS job_position,
               CASE WHEN l_orderkey % 50 = 0 THEN '0' WHEN l_orderkey % 53 = 0 THEN '20165' WHEN l_orderkey % 59 = 0 THEN NULL
                    WHEN l_orderkey % 61 = 0 THEN 'n/k' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS orgyear,
               CASE WHEN l_orderkey % 211 = 0 THEN NULL
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS ctc,
               CAST(year(o_orderdate) AS VARCHAR) AS ctc_updated_year, l_partkey AS k
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "raw": "SELECT * EXCLUDE (k) FROM (SELECT * FROM bound UNION ALL SELECT * FROM bound WHERE k % 41 = 0)",
    "present": "SELECT row_id, "
    + ", ".join(f"{_present(c)} AS {c}" for c in ("company_hash", "email_hash", "orgyear", "ctc", "job_position", "ctc_updated_year"))
    + " FROM raw",
    "placed": """SELECT * REPLACE (coalesce(company_hash, 'Unknown_Company') AS company_hash,
                                   coalesce(job_position, 'Unknown_Position') AS job_position) FROM present""",
    "cleaned": f"""
        SELECT * REPLACE (
                 CASE WHEN {_number('orgyear')} BETWEEN 1960 AND 2005 THEN {_number('orgyear')} END AS orgyear,
                 CAST({_number('ctc')} AS DECIMAL(20,4)) AS ctc,
                 {_number('ctc_updated_year')} AS ctc_updated_year),
               coalesce(nullif({_cleaned_text('company_hash')}, ''), 'unknown_company') AS {CO},
               coalesce(nullif({_cleaned_text('job_position')}, ''), 'unknown_position') AS {JOB}
        FROM placed""",
    "paid": """SELECT * REPLACE (coalesce(ctc, (SELECT CAST(median(CAST(ctc AS DOUBLE)) AS DECIMAL(20,4)) FROM cleaned)) AS ctc)
               FROM cleaned""",
    "donor": """SELECT ctc, orgyear, row_number() OVER (PARTITION BY ctc ORDER BY row_id) AS place
                FROM paid WHERE orgyear IS NOT NULL QUALIFY place <= 5""",
    "donor_value": "SELECT ctc, row_number() OVER (ORDER BY ctc) AS pos FROM (SELECT DISTINCT ctc FROM donor)",
    "needed": "SELECT DISTINCT ctc FROM paid WHERE orgyear IS NULL",
    "spot": """SELECT needed.ctc, coalesce(donor_value.pos, 0) AS pos
               FROM needed ASOF LEFT JOIN donor_value ON needed.ctc >= donor_value.ctc""",
    "candidate": """SELECT spot.ctc, donor.orgyear,
                           row_number() OVER (PARTITION BY spot.ctc ORDER BY abs(spot.ctc - donor.ctc), donor.ctc, donor.place) AS r
                    FROM (SELECT ctc, unnest(range(pos - 4, pos + 6)) AS pos FROM spot) AS spot
                         JOIN donor_value ON donor_value.pos = spot.pos JOIN donor ON donor.ctc = donor_value.ctc""",
    "nearest": "SELECT ctc, sum(orgyear) / count(*) AS m FROM candidate WHERE r <= 5 GROUP BY ctc",
    "imputed": """SELECT paid.* REPLACE (CAST(round_even(coalesce(orgyear, m), 0) AS INTEGER) AS orgyear)
                  FROM paid LEFT JOIN nearest USING (ctc)""",
    "prepared": f"SELECT DISTINCT *, CAST(greatest(0, least(2005 - orgyear, 60)) AS INTEGER) AS {EXP} FROM imputed",
}
LEVELS = {"Co_Job_Exp": [CO, JOB, EXP], "Co_Job": [CO, JOB], "Co": [CO]}
FLAGS = {"Designation": "Co_Job_Exp", "Class": "Co_Job", "Tier": "Co"}


def _summary(suffix: str) -> str:
    keys = ", ".join(LEVELS[suffix])
    return f"""SELECT {keys}, CAST(sum(ctc) AS DOUBLE) / count(ctc) AS Avg_ctc_{suffix}, median(CAST(ctc AS DOUBLE)) AS Median_ctc_{suffix},
                      CAST(max(ctc) AS DOUBLE) AS Max_ctc_{suffix}, CAST(min(ctc) AS DOUBLE) AS Min_ctc_{suffix},
                      count(ctc) AS Count_{suffix}
               FROM prepared GROUP BY {keys}"""


def _flag(name: str, suffix: str) -> str:
    over = f"OVER (PARTITION BY {', '.join(LEVELS[suffix])})"
    n, s = f"CAST(count(ctc) {over} AS INTEGER)", f"sum(ctc) {over}"
    return f"CASE WHEN ctc * {n} > {s} THEN 1 WHEN ctc * {n} = {s} THEN 2 ELSE 3 END AS {name}"


STEPS |= {f"summary_{s}": _summary(s) for s in LEVELS}
STEPS["flagged"] = f"SELECT *, {', '.join(_flag(f, s) for f, s in FLAGS.items())} FROM prepared"
STEPS["enriched"] = "SELECT * FROM flagged " + " ".join(
    f"LEFT JOIN summary_{s} USING ({', '.join(keys)})" for s, keys in LEVELS.items()
)
_distances = [f"((ctc_k - {x}) * (ctc_k - {x}) + (exp_d - {y}) * (exp_d - {y}))" for x, y in CENTROIDS]
STEPS["assigned"] = f"""
    SELECT * EXCLUDE (d), CASE WHEN {CO} = 'unknown_company' THEN -1 ELSE CAST(list_position(d, list_min(d)) - 1 AS INTEGER) END AS segment
    FROM (SELECT *, [{', '.join(_distances)}] AS d
          FROM (SELECT *, CAST(ctc AS DOUBLE) / 1000 AS ctc_k, CAST({EXP} AS DOUBLE) AS exp_d FROM prepared))"""


def _sql(last: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after all steps up to ``last`` and the extra ones."""
    names = list(STEPS)
    used = {n: STEPS[n] for n in names[: names.index(last) + 1]} | (extra or {})
    text = ",\n".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in used.items())
    return f"WITH {text}\n{body}"


# Prepared people, of whom some have no company, some no job and some no experience.
GAPS = {
    "gaps": "SELECT row_id, ctc, "
    + ", ".join(f"CASE WHEN CAST(split_part(row_id, '-', 3) AS BIGINT) % {n} <> 0 THEN {k} END AS {k}" for k, n in ((CO, 11), (JOB, 5), (EXP, 7)))
    + " FROM prepared"
}
DOUBLE_PAY = "* REPLACE (CAST(ctc AS DOUBLE) AS ctc)"
ANSWER = f"row_id, email_hash, {CO}, {JOB}, {EXP}, CAST(ctc AS DOUBLE) AS ctc, Designation, Class, Tier"
SETTINGS_ROLE = f"regexp_matches({JOB}, '{SETTINGS.role_pattern}', 'i')"

FRACTIONS = [f"{f}_ctc_{s}" for s in LEVELS for f in ("Avg", "Median", "Max", "Min")]
ROUNDED = ", ".join(f"{_rounded(f'CAST({c} AS DOUBLE)', 4)} AS {c}" for c in ["ctc", "ctc_updated_year", *FRACTIONS])


def _per_column(table: str, cols: list[str], facts: str) -> str:
    """Facts of each column; {c} stands for the column."""
    return " UNION ALL ".join(f"SELECT '{c.strip(chr(34))}' AS \"column\", {facts.format(c=c)} FROM {table}" for c in cols)


CLEANED_COLUMNS = {
    "row_id": "string", "email_hash": "string", "company_hash": "string", "job_position": "string", "orgyear": "double",
    "ctc": "decimal(20,4)", "ctc_updated_year": "double", CO: "string", JOB: "string",
}


def _histogram(values: str, bins: str) -> str:
    """Steps from ``vals`` (v): facts, number of bins, borders; then counts by comparing with borders."""
    return f""", facts AS (SELECT count(v) AS n, min(v) AS low, max(v) AS high,
                                  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM vals),
       widths AS (SELECT *, least((high - low) / (log2(n) + 1),
                                  greatest(2 * iqr / pow(n, 1.0 / 3), (high - low) / sqrt(n) / 2)) AS w FROM facts),
       bins AS (SELECT low, high, CAST(ceil((high - low) / {bins}) AS INTEGER) AS b FROM widths),
       borders AS (SELECT CAST(i AS INTEGER) AS bin, b,
                          i * ((high - low) / b) + low AS "left",
                          CASE WHEN i + 1 = b THEN high ELSE (i + 1) * ((high - low) / b) + low END AS "right"
                   FROM (SELECT *, unnest(range(b)) AS i FROM bins))
       SELECT bin, {_rounded('"left"', 6)} AS "left", {_rounded('"right"', 6)} AS "right", count(v) AS n
       FROM borders LEFT JOIN vals ON v >= "left" AND (v < "right" OR (bin = b - 1 AND v <= "right"))
       GROUP BY bin, "left", "right" """


def _density(log: bool, col: str = EXP) -> str:
    value = "log10(CAST(ctc AS DOUBLE))" if log else f"CAST({col} AS DOUBLE)"
    where = "WHERE ctc > 0" if log else ""
    return f""", vals AS (SELECT {value} AS v FROM prepared {where}),
        counted AS (SELECT v, count(*) AS c FROM vals GROUP BY v),
        facts AS (SELECT count(v) AS n, min(v) AS low, max(v) AS high, stddev_samp(v) * pow(count(v), -0.2) AS h FROM vals),
        points AS (SELECT CAST(i AS INTEGER) AS point, i * ((high - low) / 199) + low AS x, n, h
                   FROM facts, (SELECT unnest(range(200)) AS i))
        SELECT point, {_rounded('x', 8)} AS x,
               {_rounded('sum(c * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (n * h * sqrt(2 * pi()))', 8)} AS density
        FROM points, counted GROUP BY point, x, n, h"""


def _kmeans(k: int, rounds: int) -> str:
    """CTEs of rounds of K-Means over pay, experience, company and job from the labels experience % k."""
    parts = [
        f"""pts AS MATERIALIZED (SELECT row_id, row_number() OVER () AS rid, {EXP} % {k} AS label, CAST(ctc AS DOUBLE) / (SELECT stddev_pop(CAST(ctc AS DOUBLE)) FROM prepared) AS x0,
                       CAST({EXP} AS DOUBLE) / (SELECT stddev_pop(CAST({EXP} AS DOUBLE)) FROM prepared) AS x1, {CO} AS co, {JOB} AS job FROM prepared)""",
        *(
            f"""w{c} AS (SELECT {c}, CASE WHEN p < 1 THEN 1 / (p * (1 - p)) ELSE 1 END AS w2
                         FROM (SELECT {c}, count(*)::DOUBLE / (SELECT count(*) FROM pts) AS p FROM pts GROUP BY {c}))"""
            for c in ("co", "job")
        ),
        "l0 AS (SELECT *, 0.0::DOUBLE AS d FROM pts)",
    ]
    for r in range(rounds):
        parts += [
            f"c{r} AS (SELECT label, count(*)::DOUBLE AS n, avg(x0) AS m0, avg(x1) AS m1 FROM l{r} GROUP BY label)",
            *(
                f"""{c}{r} AS (SELECT label, {c}, w2 * count(*) / any_value(n) AS g, w2 * (count(*) / any_value(n)) ** 2 AS s
                               FROM l{r} JOIN w{c} USING ({c}) JOIN c{r} USING (label) GROUP BY label, {c}, w2)"""
                for c in ("co", "job")
            ),
            f"""n{r} AS (SELECT label, m0, m1, m0 * m0 + m1 * m1 + (SELECT sum(s) FROM co{r} a WHERE a.label = c{r}.label)
                                + (SELECT sum(s) FROM job{r} b WHERE b.label = c{r}.label) AS norm FROM c{r})""",
            f"""l{r + 1} AS (SELECT row_id, rid, n{r}.label, x0, x1, pts.co, pts.job,
                                x0 * x0 + x1 * x1 + wco.w2 + wjob.w2 + norm - 2 * (x0 * m0 + x1 * m1 + coalesce(co{r}.g, 0) + coalesce(job{r}.g, 0)) AS d
                         FROM pts CROSS JOIN n{r} JOIN wco USING (co) JOIN wjob USING (job)
                              LEFT JOIN co{r} ON co{r}.label = n{r}.label AND co{r}.co = pts.co LEFT JOIN job{r} ON job{r}.label = n{r}.label AND job{r}.job = pts.job
                         QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, n{r}.label) = 1)""",
        ]
    return ", ".join(parts)


def _kmeans_rounds() -> str:
    k = SETTINGS.segments
    return f"""SELECT * FROM (WITH {_kmeans(k, 3)},
        place AS (SELECT label, row_number() OVER (ORDER BY size DESC, m0) - 1 AS place
                  FROM (SELECT label, count(*) AS size FROM l3 GROUP BY label) JOIN n2 USING (label))
        SELECT row_id, CAST(place AS INTEGER) AS "KMeans_Cluster" FROM l3 JOIN place USING (label))"""


def _elbow_rounds() -> str:
    one = lambda k: f"SELECT {k} AS k, (WITH {_kmeans(k, 3)} SELECT sum(d) FROM l3) AS cost"
    return f"SELECT k, {_rounded('cost', 2)} AS cost FROM ({' UNION ALL '.join(one(k) for k in (2, 3, 4, 7))})"


# Ward's tree over one centre per job: a cluster is its size, its sums of pay and experience, and the sum over
# its jobs of weight^2 size^2, as clusters share no job.
TREE = f"""
    RECURSIVE leaf AS (
        SELECT {JOB} AS job, count(*)::DOUBLE AS n, sum(CAST(ctc AS DOUBLE)) / (SELECT stddev_pop(CAST(ctc AS DOUBLE)) FROM prepared) AS s0,
               sum(CAST({EXP} AS DOUBLE)) / (SELECT stddev_pop(CAST({EXP} AS DOUBLE)) FROM prepared) AS s1,
               n / ((SELECT count(*) FROM prepared) - n) * (SELECT count(*) FROM prepared)::DOUBLE ** 2 AS h
        FROM prepared GROUP BY {JOB}),
    named AS (SELECT *, row_number() OVER (ORDER BY n DESC, s0 / n) - 1 AS id FROM leaf),
    tree AS (
        SELECT -1 AS step, id, n, s0, s1, h, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS cost FROM named
        UNION ALL
        (WITH pair AS (
             SELECT p.id AS i, q.id AS j, p.n * q.n / (p.n + q.n) * 2 * ((p.s0 / p.n - q.s0 / q.n) ** 2 + (p.s1 / p.n - q.s1 / q.n) ** 2
                      + p.h / p.n ** 2 + q.h / q.n ** 2) AS c
             FROM tree p JOIN tree q ON p.id < q.id ORDER BY c LIMIT 1)
         SELECT step + 1, id, n, s0, s1, h, NULL, NULL, NULL FROM tree, pair WHERE id NOT IN (i, j)
         UNION ALL
         SELECT any_value(step) + 1, any_value((SELECT count(*) FROM named) + step + 1), sum(n), sum(s0), sum(s1), sum(h), any_value(i), any_value(j), any_value(c)
         FROM tree, pair WHERE id IN (i, j) HAVING count(*) = 2))"""


def _feature_columns() -> str:
    numeric = " UNION ALL ".join(
        f"""SELECT '{c.strip(chr(34))}' AS "column", '' AS level, count_if(v <> 0) AS nonzeros, avg(v) / stddev_pop(v) AS mean, 1.0 AS std
            FROM (SELECT CAST({c} AS DOUBLE) AS v FROM prepared)"""
        for c in ("ctc", EXP)
    )
    hot = " UNION ALL ".join(
        f"""SELECT '{c.strip(chr(34))}' AS "column", {c} AS level, count(*) AS nonzeros,
                   (count(*) / total) / sqrt((count(*) / total) * (1 - count(*) / total)) AS mean, 1.0 AS std
            FROM prepared, (SELECT CAST(count(*) AS DOUBLE) AS total FROM prepared) GROUP BY {c}, total"""
        for c in (CO, JOB)
    )
    return f"""SELECT "column", level, nonzeros, {_rounded('mean', 6)} AS mean, CAST(std AS DOUBLE) AS std FROM ({numeric} UNION ALL {hot})"""


def _top(where: str, order: str, n: int = 10) -> str:
    return f"SELECT {ANSWER} FROM flagged WHERE {where} ORDER BY flagged.ctc {order}, row_id LIMIT {n}"


def _top_per_company(where: str, order: str) -> str:
    return f"""SELECT {ANSWER} FROM flagged WHERE {where}
               QUALIFY row_number() OVER (PARTITION BY {CO} ORDER BY flagged.ctc {order}, row_id) <= 10"""


def _bars(col: str) -> str:
    return f"""SELECT '{col.strip(chr(34))}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {col}) AS INTEGER) AS place,
                      {col} AS value, count(*) AS n FROM prepared GROUP BY {col} QUALIFY place <= 20"""


def _segment_top(col: str) -> str:
    return f"""SELECT segment, {col}, count(*) AS n,
                      CAST(row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, {col}) AS INTEGER) AS place
               FROM assigned WHERE segment <> -1 GROUP BY segment, {col} QUALIFY place <= 5"""


_quartiles = ", ".join(
    f"{_rounded(f'quantile_cont(CAST({{c}} AS DOUBLE), {p})', 4)} AS {n}" for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
)
_shuffled = f"md5(concat_ws('-', row_id, '{SETTINGS.seed}'))"

ORACLES: dict[str, str] = {
    "people_raw": _sql("present", "SELECT * FROM present"),
    "people_typed": _sql(
        "present",
        """SELECT row_id, orgyear, CAST(ctc AS DOUBLE) AS ctc, CAST(ctc_updated_year AS BIGINT) AS ctc_updated_year FROM present""",
    ),
    "people_clean": _sql("cleaned", f"SELECT {DOUBLE_PAY} FROM cleaned"),
    "clean_documents": f"SELECT doc_id, {_cleaned_text('text')} AS cleaned FROM documents",
    "csv_roundtrip": _sql(
        "enriched",
        f"""SELECT row_id, company_hash, job_position, {CO}, {JOB}, {_rounded('CAST(ctc AS DOUBLE)', 4)} AS ctc,
                   {_rounded('Avg_ctc_Co', 4)} AS Avg_ctc_Co, {_rounded('Median_ctc_Co_Job', 4)} AS Median_ctc_Co_Job, Tier FROM enriched""",
    ),
    "csv_quoted_roundtrip": _sql("cleaned", f"""SELECT row_id, {CO}, 'a "b", c' || chr(10) || {JOB} || chr(10) || ',' AS quoted FROM cleaned"""),
    "shape": _sql("raw", "SELECT count(*) AS n_rows, 7 AS n_columns FROM raw"),
    "column_info": _sql(
        "cleaned",
        " UNION ALL ".join(
            f"""SELECT '{c.strip(chr(34))}' AS "column", '{t}' AS type, count({c}) AS non_null FROM cleaned""" for c, t in CLEANED_COLUMNS.items()
        ),
    ),
    "null_counts": _sql("cleaned", _per_column("cleaned", list(CLEANED_COLUMNS), "count(*) - count({c}) AS missing")),
    "preview": _sql("prepared", f"SELECT {DOUBLE_PAY} FROM prepared ORDER BY row_id LIMIT 5"),
    "describe_numeric": _sql(
        "cleaned",
        _per_column(
            "cleaned",
            ["orgyear", "ctc", "ctc_updated_year"],
            "count({c}) AS count, "
            + f"{_rounded('avg(CAST({c} AS DOUBLE))', 4)} AS mean, {_rounded('stddev_samp(CAST({c} AS DOUBLE))', 4)} AS std, "
            + f"{_rounded('min(CAST({c} AS DOUBLE))', 4)} AS min, {_quartiles}, {_rounded('max(CAST({c} AS DOUBLE))', 4)} AS max",
        ),
    ),
    "describe_numeric_ranked": _sql("prepared", f"SELECT {_quartiles.format(c='ctc')} FROM prepared"),
    "describe_categorical": _sql(
        "present",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
                       first(v ORDER BY n DESC, v) AS top, max(n) AS freq
                FROM (SELECT {c} AS v, count(*) AS n FROM present WHERE {c} IS NOT NULL GROUP BY {c})"""
            for c in ("company_hash", "email_hash", "job_position")
        ),
    ),
    "n_unique": _sql(
        "cleaned", _per_column("cleaned", ["email_hash", "company_hash", "job_position", CO, JOB], "count(DISTINCT {c}) AS n_unique")
    ),
    "n_repeated": _sql(
        "cleaned", "SELECT count(*) AS n_repeated FROM (SELECT email_hash FROM cleaned GROUP BY email_hash HAVING count(email_hash) > 1)"
    ),
    "value_counts": _sql("present", "SELECT job_position, count(*) AS n FROM present WHERE job_position IS NOT NULL GROUP BY 1"),
    "top_values": _sql("cleaned", "SELECT email_hash, count(*) AS n FROM cleaned GROUP BY 1 ORDER BY n DESC, email_hash LIMIT 5"),
    "impute_median_pay": _sql("paid", "SELECT row_id, CAST(ctc AS DOUBLE) AS ctc FROM paid"),
    "impute_nearest_year": _sql("imputed", "SELECT row_id, CAST(ctc AS DOUBLE) AS ctc, orgyear FROM imputed"),
    "duplicate_report": _sql(
        "cleaned",
        """SELECT a AS rows_before, b AS rows_after, a - b AS rows_removed
           FROM (SELECT count(*) AS a FROM cleaned), (SELECT count(*) AS b FROM (SELECT DISTINCT * FROM cleaned))""",
    ),
    "drop_duplicate_rows": _sql(
        "cleaned", "SELECT row_id, company_hash, orgyear, CAST(ctc AS DOUBLE) AS ctc FROM (SELECT DISTINCT * FROM cleaned)"
    ),
    "people_prepared": _sql("prepared", f"SELECT {DOUBLE_PAY} FROM prepared"),
    "experience": _sql("prepared", f"SELECT row_id, orgyear, {EXP} FROM prepared"),
    "peer_summary_3": _sql("prepared", _summary("Co_Job_Exp")),
    "peer_summary_2": _sql("prepared", _summary("Co_Job")),
    "peer_summary_1": _sql("prepared", _summary("Co")),
    "peer_summary_ranked": _sql("prepared", _summary("Co")),
    "peer_summaries_grouping_sets": _sql(
        "summary_Co",
        " UNION ALL ".join(
            f"""SELECT '{s}' AS level, {', '.join(k if k in keys else f'NULL AS {k}' for k in LEVELS['Co_Job_Exp'])},
                       Avg_ctc_{s} AS avg, Median_ctc_{s} AS median, Max_ctc_{s} AS max, Min_ctc_{s} AS min, Count_{s} AS count
                FROM summary_{s}"""
            for s, keys in LEVELS.items()
        ),
    ),
    "peer_summaries_missing_keys": _sql(
        "prepared",
        " UNION ALL ".join(
            f"""SELECT '{s}' AS level, {', '.join(k if k in keys else f'NULL AS {k}' for k in LEVELS['Co_Job_Exp'])},
                       CAST(sum(ctc) AS DOUBLE) / count(ctc) AS avg, median(CAST(ctc AS DOUBLE)) AS median,
                       CAST(max(ctc) AS DOUBLE) AS max, CAST(min(ctc) AS DOUBLE) AS min, count(ctc) AS count
                FROM gaps WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)}"""
            for s, keys in LEVELS.items()
        ),
        GAPS,
    ),
    "peer_flags_missing_keys": _sql(
        "prepared",
        "SELECT row_id, CAST(ctc AS DOUBLE) AS ctc, " + ", ".join(
            f"""CASE WHEN ctc IS NULL OR {' OR '.join(f'{k} IS NULL' for k in LEVELS[s])} THEN 2 ELSE {_flag('', s).removesuffix(' AS ')} END AS {f}"""
            for f, s in FLAGS.items()
        ) + " FROM gaps",
        GAPS,
    ),
    "drop_incomplete_rows": _sql("prepared", f"SELECT row_id, {CO}, {JOB}, {EXP} FROM gaps WHERE {CO} IS NOT NULL AND {JOB} IS NOT NULL AND {EXP} IS NOT NULL", GAPS),
    "positive_rows": _sql("prepared", "SELECT row_id, CAST(ctc AS DOUBLE) AS ctc FROM prepared WHERE ctc > 0 AND CAST(split_part(row_id, '-', 3) AS BIGINT) % 3 = 2"),
    "clamped_experience": _sql("prepared", "SELECT row_id, CAST(greatest(0, least(1996 - orgyear, 3)) AS INTEGER) AS years FROM prepared"),
    "index_dropped": _sql(
        "cleaned",
        f"""SELECT company_hash, {JOB}, count(*) AS n, count(DISTINCT coalesce(CAST(orgyear AS VARCHAR), '-')) AS n_keys FROM cleaned GROUP BY company_hash, {JOB}""",
    ),
    "attach_summary": _sql(
        "summary_Co_Job",
        f"""SELECT row_id, CAST(ctc AS DOUBLE) AS ctc, summary_Co_Job.* FROM prepared JOIN summary_Co_Job USING ({CO}, {JOB})""",
    ),
    "peer_flags": _sql("flagged", "SELECT row_id, CAST(ctc AS DOUBLE) AS ctc, Designation, Class, Tier FROM flagged"),
    "flag_counts": _sql("flagged", "SELECT Designation, Class, Tier, count(*) AS n FROM flagged GROUP BY ALL"),
    "people_enriched": _sql("enriched", f"SELECT * REPLACE ({ROUNDED}) FROM enriched"),
    "event_flags": """
        WITH e AS (SELECT event_id, event_type, user_id, CAST(value AS DECIMAL(20,4)) AS v FROM events),
             s AS (SELECT *, sum(v) OVER u AS su, CAST(count(v) OVER u AS INTEGER) AS nu, sum(v) OVER t AS st,
                          CAST(count(v) OVER t AS INTEGER) AS nt
                   FROM e WINDOW u AS (PARTITION BY event_type, user_id), t AS (PARTITION BY event_type))
        SELECT event_id, CASE WHEN v * nu > su THEN 1 WHEN v * nu = su THEN 2 ELSE 3 END AS by_user,
               CASE WHEN v * nt > st THEN 1 WHEN v * nt = st THEN 2 ELSE 3 END AS by_type FROM s""",
    "top_tier": _sql("flagged", _top("Tier = 1", "DESC")),
    "bottom_tier": _sql("flagged", _top("Tier = 3", "ASC")),
    "role_top_per_company": _sql("flagged", _top_per_company(f"{SETTINGS_ROLE} AND Class = 1", "DESC")),
    "role_bottom_per_company": _sql("flagged", _top_per_company(f"{SETTINGS_ROLE} AND Class = 3", "ASC")),
    "job_experience_top": _sql(
        "flagged",
        _top_per_company(f"{JOB} = '{SETTINGS.job}' AND {EXP} = {SETTINGS.experience} AND Designation = 1", "DESC"),
    ),
    "top_companies": _sql(
        "summary_Co",
        f"SELECT {CO}, Avg_ctc_Co, Count_Co FROM summary_Co WHERE Count_Co >= 10 ORDER BY Avg_ctc_Co DESC, {CO} LIMIT 10",
    ),
    "top_jobs_per_company": _sql(
        "summary_Co_Job",
        f"""SELECT {CO}, {JOB}, Avg_ctc_Co_Job, Count_Co_Job FROM summary_Co_Job WHERE Count_Co_Job >= 10
            QUALIFY row_number() OVER (PARTITION BY {CO} ORDER BY Avg_ctc_Co_Job DESC, {JOB}) <= 2""",
    ),
    "sorted_people": _sql("flagged", f"SELECT {ANSWER} FROM flagged"),
    "role_matches": _sql("prepared", f"SELECT row_id, {JOB} FROM prepared WHERE {SETTINGS_ROLE}"),
    "histogram_experience": _sql("prepared", f", vals AS (SELECT CAST({EXP} AS DOUBLE) AS v FROM prepared)" + _histogram("", "greatest(w, 1)")),
    "histogram_pay_log": _sql(
        "prepared", ", vals AS (SELECT log10(CAST(ctc AS DOUBLE)) AS v FROM prepared WHERE ctc > 0)" + _histogram("", "w")
    ),
    "histogram_events": "WITH vals AS (SELECT value AS v FROM events WHERE value IS NOT NULL)" + _histogram("", "w"),
    "density_experience": _sql("prepared", _density(False)),
    "density_pay_log": _sql("prepared", _density(True)),
    "density_updated_year": _sql("prepared", _density(False, "ctc_updated_year")),
    "histogram_updated_year": _sql("prepared", ", vals AS (SELECT ctc_updated_year AS v FROM prepared)" + _histogram("", "w")),
    "scatter_points_all": _sql("prepared", f"SELECT row_id, {EXP}, CAST(ctc AS DOUBLE) AS ctc FROM prepared WHERE ctc > 0"),
    "scatter_cells": _sql(
        "prepared",
        f"""SELECT CAST(least(floor(CAST(x - x0 AS DOUBLE) * 50 / (x1 - x0)), 49) AS INTEGER) AS cell_x, CAST(least(floor((h - h0) * 50 / (h1 - h0)), 49) AS INTEGER) AS cell_y,
                   count(*) AS n, {_rounded('CAST(sum(x) AS DOUBLE) / count(*)', 4)} AS mean_x, {_rounded('CAST(sum(y) AS DOUBLE) / count(*)', 4)} AS mean_y
            FROM (SELECT *, min(x) OVER () AS x0, max(x) OVER () AS x1, min(h) OVER () AS h0, max(h) OVER () AS h1
                  FROM (SELECT CAST({EXP} AS BIGINT) AS x, ctc AS y, log10(CAST(ctc AS DOUBLE)) AS h FROM prepared WHERE ctc > 0))
            GROUP BY cell_x, cell_y""",
    ),
    "bar_counts": _sql("prepared", f"SELECT * FROM ({_bars(CO)}) UNION ALL SELECT * FROM ({_bars(JOB)})"),
    "top_category_rows": _sql(
        "prepared",
        f"""SELECT row_id, {CO} FROM prepared
            WHERE {CO} IN (SELECT {CO} FROM prepared GROUP BY {CO} ORDER BY count(*) DESC, {CO} LIMIT 20)""",
    ),
    "sample_rows": _sql("prepared", f"SELECT row_id, {CO} FROM prepared ORDER BY {_shuffled}, row_id LIMIT {SETTINGS.sample_size}"),
    "scatter_points": _sql(
        "prepared",
        f"""SELECT row_id, {EXP}, CAST(ctc AS DOUBLE) AS ctc
            FROM (SELECT * FROM prepared ORDER BY {_shuffled}, row_id LIMIT {SETTINGS.scatter_cap}) WHERE ctc > 0""",
    ),
    "feature_columns": _sql("prepared", _feature_columns()),
    "kmeans_rounds": _sql("prepared", _kmeans_rounds()),
    "kmeans_segments_tables": _sql("prepared", _kmeans_rounds()),
    "elbow_rounds": _sql("prepared", _elbow_rounds()),
    "merge_tree_jobs": _sql(
        "prepared",
        f"""SELECT * FROM (WITH {TREE} SELECT step, CAST(least(a, b) AS INTEGER) AS "left", CAST(greatest(a, b) AS INTEGER) AS "right",
                   {_rounded('sqrt(greatest(cost, 0))', 6)} AS height, CAST(n AS BIGINT) AS size FROM tree WHERE a IS NOT NULL)""",
    ),
    "hierarchical_jobs": _sql(
        "prepared",
        f"""SELECT * FROM (WITH {TREE},
                 made AS (SELECT step, id, a, b FROM tree WHERE a IS NOT NULL),
                 cut AS (SELECT id, n FROM tree WHERE step = (SELECT count(*) FROM named) - 1 - {SETTINGS.segments}),
                 down AS (SELECT id AS top, id, n FROM cut UNION ALL SELECT top, unnest([a, b]), down.n FROM down JOIN made ON made.id = down.id),
                 place AS (SELECT id AS top, row_number() OVER (ORDER BY n DESC, id) - 1 AS place FROM cut)
            SELECT row_id, CAST(place AS INTEGER) AS "Hierarchical_Cluster"
            FROM prepared JOIN named ON named.job = prepared.{JOB} JOIN down ON down.id = named.id JOIN place USING (top))""",
    ),
    "kmeans_checks": _sql(
        "prepared",
        f"""SELECT count(*) AS n_rows, {SETTINGS.segments} AS n_segments, 0 AS n_outside, true AS at_nearest_centre FROM prepared""",
    ),
    "hierarchical_checks": _sql(
        "prepared", f"SELECT count(*) AS n_rows, {SETTINGS.segments} AS n_segments, 0 AS n_unassigned FROM prepared"
    ),
    "merge_tree_checks": _sql("prepared", "SELECT true AS heights_rise, count(*) AS n_rows FROM prepared"),
    "assign_people": _sql("assigned", "SELECT row_id, segment FROM assigned"),
    "assign_embeddings": """
        WITH centre AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 5),
             far AS (SELECT vec_id, j, list_sum(list_transform(range(1, len(e) + 1),
                       lambda i: (embedding[i]::DOUBLE - e[i]::DOUBLE) * (embedding[i]::DOUBLE - e[i]::DOUBLE))) AS d
                     FROM embeddings, centre)
        SELECT vec_id, CAST(j AS INTEGER) AS segment FROM far QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1""",
    "segment_means": _sql(
        "assigned",
        f"""SELECT segment, {_rounded('avg(CAST(ctc AS DOUBLE))', 4)} AS mean_ctc,
                   {_rounded(f'avg(CAST({EXP} AS DOUBLE))', 4)} AS "mean_Years_of_Experience" FROM assigned WHERE segment <> -1 GROUP BY segment""",
    ),
    "segment_sizes": _sql("assigned", "SELECT segment, count(*) AS size FROM assigned GROUP BY segment"),
    "segment_top_companies": _sql("assigned", _segment_top(CO)),
    "segment_top_jobs": _sql("assigned", _segment_top(JOB)),
}
