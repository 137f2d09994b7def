"""One SQL text per registered query."""

from __future__ import annotations

from courselake.functions.permutation import FACTOR, PRIME, ROUNDS, TRIED, round_keys
from courselake.operators.quality import core_checks, snapshot_checks
from courselake.schemas import RANDOM_SEED
from oracles.newton import calibrated_mean, newton
from oracles.relations import half_up, sql
from oracles.trees import boosted_leaves, exact_splits

AK = "code_module, code_presentation, id_student"
AKW = f"{AK}, course_week"
ORACLES: dict[str, str] = {}


def add(name: str, needs: str, body: str, **extra: str) -> None:
    ORACLES[name] = sql(needs, body, **extra)


# --- landing form ------------------------------------------------------------

RAW = {
    "courses": ("courses", ["code_module", "code_presentation", "presentation_length_days"]),
    "assessments": (
        "assessments",
        ["code_module", "code_presentation", "id_assessment",
         "' ' || assessment_type || ' '", "due_day", "weight"],
    ),
    "vle": (
        "resources",
        ["id_site", "code_module", "code_presentation", "' ' || activity_type || ' '",
         "week_from", "week_to"],
    ),
    "student_info": (
        "info",
        ["code_module", "code_presentation", "id_student", "gender", "' ' || region || ' '",
         "highest_education", "imd_band", "age_band", "previous_attempts", "studied_credits",
         "disability", "final_result"],
    ),
    "student_registration": (
        "registration",
        ["code_module", "code_presentation", "id_student", "registration_day",
         "unregistration_day"],
    ),
    "student_assessment": (
        "submissions",
        ["id_assessment", "id_student", "submitted_day", "is_banked::INTEGER", "score"],
    ),
    "student_vle": (
        "interactions",
        ["code_module", "code_presentation", "id_student", "id_site", "activity_day",
         "click_count"],
    ),
}
NAMES = {
    "courses": "code_module,code_presentation,module_presentation_length",
    "assessments": "code_module,code_presentation,id_assessment,assessment_type,date,weight",
    "vle": "id_site,code_module,code_presentation,activity_type,week_from,week_to",
    "student_info": "code_module,code_presentation,id_student,gender,region,highest_education,"
    "imd_band,age_band,num_of_prev_attempts,studied_credits,disability,final_result",
    "student_registration": "code_module,code_presentation,id_student,date_registration,"
    "date_unregistration",
    "student_assessment": "id_assessment,id_student,date_submitted,is_banked,score",
    "student_vle": "code_module,code_presentation,id_student,id_site,date,sum_click",
}
FILES = {
    "courses": "courses.csv",
    "assessments": "assessments.csv",
    "vle": "vle.csv",
    "student_info": "studentInfo.csv",
    "student_registration": "studentRegistration.csv",
    "student_assessment": "studentAssessment.csv",
    "student_vle": "studentVle.csv",
}
ALL = "courses assessments resources info registration submissions interactions"


def text(cell: str) -> str:
    return f"coalesce(({cell})::VARCHAR, '?')"


add(
    "src_land",
    ALL,
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, "
        f"sum(length({' || '.join(text(c) for c in cells)}))::BIGINT AS characters FROM {rel}"
        for t, (rel, cells) in RAW.items()
    ),
)


def fingerprints(table: str) -> str:
    relation, cells = RAW[table]
    marked = ", ".join(f"CASE WHEN {text(c)} IN ('', '?') THEN '?' ELSE {text(c)} END" for c in cells)
    figures = [
        ("rows", "count(*)"),
        ("sum", "coalesce(sum(h::HUGEINT) % 9007199254740992, 0)::BIGINT"),
        ("xor", "coalesce(bit_xor(h), 0)"),
    ]
    both = ", ".join(f"{f} AS {side}_{n}" for side in ("expected", "landed") for n, f in figures)
    return f"""SELECT '{FILES[table]}' AS file, {both}, true AS agrees
      FROM (SELECT ('0x' || substr(md5(concat_ws('|', {marked})), 1, 13))::BIGINT AS h FROM {relation})"""


add("src_expected_files", ALL, " UNION ALL ".join(fingerprints(t) for t in RAW))
add(
    "aud_rows",
    ALL,
    " UNION ALL ".join(
        f"SELECT '{FILES[t]}' AS file, count(*) AS rows, {len(cells)} AS columns, "
        f"'{NAMES[t]}' AS column_names FROM {rel}"
        for t, (rel, cells) in RAW.items()
    ),
)
add(
    "aud_missing",
    ALL,
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{FILES[t]}' AS file, '{n}' AS column_name, "
        f"count(*) FILTER ({text(c)} IN ('', '?')) AS missing FROM {rel}"
        for t, (rel, cells) in RAW.items()
        for n, c in zip(NAMES[t].split(","), cells)
    )
    + ") WHERE missing > 0",
)
add(
    "aud_scale",
    ALL,
    f"""SELECT (SELECT count(*) FROM courses) + (SELECT count(*) FROM assessments)
             + (SELECT count(*) FROM resources) + (SELECT count(*) FROM info)
             + (SELECT count(*) FROM registration) + (SELECT count(*) FROM submissions)
             + (SELECT count(*) FROM interactions) AS csv_rows,
           (SELECT count(DISTINCT id_student) FROM info) AS unique_students,
           (SELECT count(*) FROM (SELECT DISTINCT {AK} FROM info)) AS student_module_attempts,
           (SELECT count(DISTINCT code_module) FROM courses) AS modules,
           (SELECT count(*) FROM (SELECT DISTINCT code_module, code_presentation FROM courses))
             AS module_presentations,
           (SELECT count(DISTINCT id_assessment) FROM assessments) AS assessments,
           (SELECT count(*) FROM interactions) AS activity_records""",
)
add(
    "aud_anomalies",
    "info registration assessments",
    f"""SELECT (SELECT count(*) FROM info) - (SELECT count(*) FROM (SELECT DISTINCT {AK}
               FROM info)) AS student_attempt_duplicates,
           (SELECT count(*) FROM registration) - (SELECT count(*) FROM (SELECT DISTINCT {AK}
               FROM registration)) AS registration_attempt_duplicates,
           (SELECT count(*) FROM info WHERE imd_band IS NULL) AS missing_imd_band,
           (SELECT count(*) FROM assessments WHERE due_day IS NULL)
             AS missing_assessment_due_dates,
           (SELECT count(*) FROM registration WHERE unregistration_day IS NULL)
             AS missing_unregistration_dates""",
)

# --- staging and core --------------------------------------------------------

add("stg_courses", "courses", "SELECT * FROM courses")
add("stg_assessments", "assessments", "SELECT * REPLACE (weight::DOUBLE AS weight) FROM assessments")
add("stg_resources", "resources", "SELECT * FROM resources")
add("stg_student_info", "info", "SELECT * FROM info")
add("stg_registration", "registration", "SELECT * FROM registration")
add("stg_submissions", "submissions", "SELECT * REPLACE (score::DOUBLE AS score) FROM submissions")
add("stg_interactions", "interactions", "SELECT * FROM interactions")
add(
    "stg_quarantine",
    "submissions",
    """SELECT id_assessment::VARCHAR AS id_assessment, id_student::VARCHAR AS id_student,
              CASE WHEN (id_assessment + id_student) % 43 = 0
                    AND (id_assessment + id_student) % 41 = 0 THEN 'date_submitted,score'
                   WHEN (id_assessment + id_student) % 43 = 0 THEN 'date_submitted'
                   WHEN (id_assessment + id_student) % 41 = 0 THEN 'score'
                   ELSE '' END AS reason
       FROM submissions""",
)
SUBMITTED = RAW["student_assessment"][1]
add(
    "src_rejected_lines",
    "submissions",
    f"""SELECT id_assessment::VARCHAR AS id_assessment, id_student::VARCHAR AS id_student,
              CASE WHEN n % 37 = 0 THEN {" || ',' || ".join(map(text, SUBMITTED))} || ',more'
                   WHEN n % 47 = 0 THEN {" || ',' || ".join(map(text, SUBMITTED[:-1]))}
                   ELSE '' END AS line,
              CASE WHEN n % 37 = 0 THEN 'too many fields'
                   WHEN n % 47 = 0 THEN 'too few fields' ELSE '' END AS reason
       FROM (SELECT *, id_assessment + id_student AS n FROM submissions)""",
)
add("core_attempts", "attempts", "SELECT * FROM attempts")
add(
    "core_counts",
    "courses assessments resources attempts submissions interactions",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {r}"
        for n, r in [("presentations", "courses"), ("assessments", "assessments"),
                     ("resources", "resources"), ("attempts", "attempts"),
                     ("submissions", "submissions"), ("interactions", "interactions")]
    ),
)

# --- copies with faults ------------------------------------------------------

FAULTY = {
    "f_courses": """
        SELECT code_module,
               CASE WHEN code_module = 'CCC' AND code_presentation = '2013B' THEN '2015B'
                    ELSE code_presentation END AS code_presentation,
               CASE WHEN code_module = 'AAA' THEN 0 ELSE presentation_length_days END
                 AS presentation_length_days
        FROM courses WHERE NOT (code_module = 'DDD' AND code_presentation = '2014J')""",
    "f_resources": "SELECT * FROM resources WHERE id_site % 17 <> 0",
    "f_info": """
        SELECT info.* REPLACE (
                 CASE WHEN id_student % 31 = 0 THEN 'Other' ELSE final_result END
                   AS final_result,
                 CASE WHEN id_student % 37 <> 0 THEN gender END AS gender,
                 CASE WHEN id_student % 41 = 0 THEN 0 ELSE studied_credits END
                   AS studied_credits)
        FROM info, (SELECT unnest([1, 2]) AS copy)
        WHERE id_student % 19 <> 0 AND (copy = 1 OR id_student % 23 = 0)""",
    "f_registration": """
        SELECT * REPLACE (CASE WHEN id_student % 13 = 0 THEN registration_day - 1
                               ELSE unregistration_day END AS unregistration_day)
        FROM registration""",
    "f_assessments": """
        SELECT * REPLACE (CASE WHEN id_assessment % 10 = 3 THEN 120 ELSE weight END AS weight)
        FROM assessments""",
    "f_submissions": """
        SELECT submissions.* REPLACE (CASE WHEN (id_assessment + id_student) % 59 = 0 THEN 150
                                           ELSE score END AS score)
        FROM submissions, (SELECT unnest([1, 2]) AS copy)
        WHERE copy = 1 OR (id_assessment + id_student) % 71 = 0""",
    "f_interactions": """
        SELECT * REPLACE (CASE WHEN id_site % 29 = 0 THEN -click_count ELSE click_count END
                            AS click_count)
        FROM interactions""",
    "f_attempts": f"""
        SELECT f_info.*, registration_day, unregistration_day
        FROM f_info LEFT JOIN f_registration USING ({AK})""",
}
FAULTY_TABLES = {
    "presentations": "f_courses",
    "assessments": "f_assessments",
    "resources": "f_resources",
    "attempts": "f_attempts",
    "submissions": "f_submissions",
    "interactions": "f_interactions",
}


def violations(rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS constraint_name, ({q})::BIGINT AS violations"
        for t, c, q in rows
    )


def repeated(table: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) > 1)"


def orphans(child: str, parent: str, keys: str, null_is_orphan: bool = False) -> str:
    match = " AND ".join(f"c.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    known = " AND ".join(f"c.{k.strip()} IS NOT NULL" for k in keys.split(","))
    also = "" if null_is_orphan else f" AND {known}"
    return (
        f"SELECT count(*) FROM {child} c WHERE NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE {match}){also}"
    )


PK = "code_module, code_presentation"
add(
    "con_pk",
    ALL,
    violations(
        [
            ("presentations", "primary key", repeated("f_courses", PK)),
            ("assessments", "primary key", repeated("f_assessments", "id_assessment")),
            ("resources", "primary key", repeated("f_resources", f"id_site, {PK}")),
            ("attempts", "primary key", repeated("f_attempts", AK)),
            ("submissions", "primary key", repeated("f_submissions", "id_assessment, id_student")),
        ]
    ),
    **FAULTY,
)
add(
    "con_fk",
    ALL,
    violations(
        [
            (t, "references presentations", orphans(f, "f_courses", PK))
            for t, f in [("assessments", "f_assessments"), ("resources", "f_resources"),
                         ("attempts", "f_attempts")]
        ]
        + [
            ("submissions", "references assessments",
             orphans("f_submissions", "f_assessments", "id_assessment"))
        ]
    ),
    **FAULTY,
)
MANDATORY = {
    "presentations": "code_module,code_presentation,presentation_length_days",
    "assessments": "id_assessment,code_module,code_presentation,assessment_type,weight",
    "resources": "id_site,code_module,code_presentation,activity_type",
    "attempts": "code_module,code_presentation,id_student,gender,region,highest_education,"
    "age_band,previous_attempts,studied_credits,disability,final_result",
    "submissions": "id_assessment,id_student,submitted_day,is_banked",
    "interactions": "code_module,code_presentation,id_student,id_site,activity_day,click_count",
}
add(
    "con_not_null",
    ALL,
    violations(
        [
            (t, f"not null {c}",
             f"SELECT count(*) - count({c}) FROM {FAULTY_TABLES[t]}")
            for t, columns in MANDATORY.items()
            for c in columns.split(",")
        ]
    ),
    **FAULTY,
)
CONDITIONS = [
    ("presentations", "length_positive", "presentation_length_days <= 0"),
    ("assessments", "assessment_type_known", "assessment_type NOT IN ('TMA', 'CMA', 'Exam')"),
    ("assessments", "weight_in_range", "weight < 0 OR weight > 100"),
    ("attempts", "previous_attempts_not_negative", "previous_attempts < 0"),
    ("attempts", "credits_positive", "studied_credits <= 0"),
    ("attempts", "disability_flag", "disability NOT IN ('Y', 'N')"),
    ("attempts", "final_result_known",
     "final_result NOT IN ('Distinction', 'Pass', 'Fail', 'Withdrawn')"),
    ("submissions", "score_in_range", "score < 0 OR score > 100"),
    ("interactions", "clicks_not_negative", "click_count < 0"),
]
add(
    "con_check",
    ALL,
    violations(
        [(t, n, f"SELECT count(*) FROM {FAULTY_TABLES[t]} WHERE {c}") for t, n, c in CONDITIONS]
    ),
    **FAULTY,
)

CLEAN_TABLES = {t: f.removeprefix("f_") for t, f in FAULTY_TABLES.items()}
add(
    "con_clean",
    f"{ALL} attempts",
    violations(
        [
            ("presentations", "primary key", repeated("courses", PK)),
            ("assessments", "primary key", repeated("assessments", "id_assessment")),
            ("resources", "primary key", repeated("resources", f"id_site, {PK}")),
            ("attempts", "primary key", repeated("attempts", AK)),
            ("submissions", "primary key", repeated("submissions", "id_assessment, id_student")),
            *[
                (t, "references presentations", orphans(t, "courses", PK))
                for t in ("assessments", "resources", "attempts")
            ],
            ("submissions", "references assessments", orphans("submissions", "assessments", "id_assessment")),
            *[
                (t, f"not null {c}", f"SELECT count(*) - count({c}) FROM {CLEAN_TABLES[t]}")
                for t, columns in MANDATORY.items()
                for c in columns.split(",")
            ],
            *[(t, n, f"SELECT count(*) FROM {CLEAN_TABLES[t]} WHERE {c}") for t, n, c in CONDITIONS],
        ]
    ),
)

# --- quality -----------------------------------------------------------------

DETAILS = {c.name: (c.severity, c.detail) for c in core_checks() + snapshot_checks()}


def core_counts(p: str = "") -> dict[str, str]:
    """Failing rows of each core check; p prefixes the relation names."""
    info = f"{p}info"
    return {
        "source_courses_row_count": f"SELECT abs(count(*) - 22) FROM {p}courses",
        "source_student_info_row_count": f"SELECT abs(count(*) - 32593) FROM {info}",
        "source_activity_row_count": f"SELECT abs(count(*) - 10655280) FROM {p}interactions",
        "duplicate_student_attempts": repeated(info, AK),
        "duplicate_assessment_submissions": repeated(
            f"{p}submissions", "id_assessment, id_student"
        ),
        "orphan_assessments": orphans(f"{p}assessments", f"{p}courses", PK, True),
        "orphan_submissions": orphans(
            f"{p}submissions", f"{p}assessments", "id_assessment", True
        ),
        "registrations_without_attempts": orphans(f"{p}registration", info, AK, True),
        "activity_without_resources": orphans(
            f"{p}interactions", f"{p}resources", f"{PK}, id_site", True
        ),
        "activity_without_attempts": orphans(f"{p}interactions", info, AK, True),
        "invalid_assessment_weights":
            f"SELECT count(*) FROM {p}assessments WHERE weight NOT BETWEEN 0 AND 100",
        "invalid_score_ranges":
            f"SELECT count(*) FROM {p}submissions WHERE score NOT BETWEEN 0 AND 100",
        "invalid_final_results":
            f"SELECT count(*) FROM {info} WHERE final_result NOT IN "
            "('Distinction', 'Pass', 'Fail', 'Withdrawn')",
        "negative_click_counts":
            f"SELECT count(*) FROM {p}interactions WHERE click_count < 0",
        "registration_after_unregistration":
            f"SELECT count(*) FROM {p}registration WHERE unregistration_day < registration_day",
        "unexpected_module_codes":
            f"SELECT count(*) FROM {p}courses WHERE code_module NOT IN "
            "('AAA', 'BBB', 'CCC', 'DDD', 'EEE', 'FFF', 'GGG')",
        "unexpected_presentation_codes":
            f"SELECT count(*) FROM {p}courses WHERE code_presentation NOT IN "
            "('2013B', '2013J', '2014B', '2014J')",
        "missing_imd_band": f"SELECT count(*) FROM {info} WHERE imd_band IS NULL",
        "missing_assessment_due_dates":
            f"SELECT count(*) FROM {p}assessments WHERE due_day IS NULL",
        "activity_before_course_start":
            f"SELECT count(*) FROM {p}interactions WHERE activity_day < 0",
    }


SNAPSHOT_COUNTS = {
    "duplicate_model_snapshots": repeated("snapshots", AKW),
    "invalid_snapshot_dates":
        "SELECT count(*) FROM snapshots WHERE course_week NOT BETWEEN 0 AND 12 "
        "OR snapshot_day <> 7 * course_week + 6",
    "future_information_in_snapshots":
        "SELECT count(*) FROM snapshots WHERE latest_feature_day > snapshot_day",
    "invalid_model_targets":
        "SELECT count(*) FROM snapshots WHERE target_next_assessment_event NOT IN (0, 1) "
        "OR target_withdrawal_28d NOT IN (0, 1) OR next_assessment_due_day <= snapshot_day",
}


def results(day: int, counts: dict[str, str]) -> str:
    parts = []
    for name, q in counts.items():
        severity, detail = DETAILS[name]
        status = (
            "'profile'" if severity == "informational"
            else f"CASE WHEN ({q}) = 0 THEN 'pass' ELSE 'fail' END"
        )
        parts.append(
            f"SELECT '2020-01-0{day}' AS run_at, '{name}' AS check_name, "
            f"'{severity}' AS severity, ({q})::BIGINT AS failing_rows, {status} AS status, "
            f"'{detail}' AS detail"
        )
    return " UNION ALL ".join(parts)


BOTH = f"{ALL} snapshots"
add("qc_core", ALL, results(1, core_counts()))
add("qc_faults", ALL, results(1, core_counts("f_")), **FAULTY)
add("qc_snapshots", "snapshots", results(2, SNAPSHOT_COUNTS))
add("qc_replace", BOTH, results(1, core_counts()) + " UNION ALL " + results(2, SNAPSHOT_COUNTS))
add("qc_stored", BOTH, results(1, core_counts()) + " UNION ALL " + results(2, SNAPSHOT_COUNTS))
add("qc_latest", BOTH, results(2, core_counts()) + " UNION ALL " + results(2, SNAPSHOT_COUNTS))
add(
    "qc_gate",
    BOTH,
    """SELECT count(*) FILTER (severity = 'error' AND status = 'fail') AS failed_errors,
              count(*) FILTER (severity = 'error' AND status = 'fail') = 0 AS passed FROM r""",
    r=results(1, core_counts()) + " UNION ALL " + results(2, SNAPSHOT_COUNTS),
)
add(
    "gal_05",
    BOTH,
    "SELECT severity, check_name, failing_rows, status, detail FROM r",
    r=results(1, core_counts()) + " UNION ALL " + results(2, SNAPSHOT_COUNTS),
)
add(
    "snk_quality",
    ALL,
    "SELECT check_name, severity, failing_rows, status, detail FROM r",
    r=results(1, core_counts()),
)
add(
    "qc_activity_without_resources",
    ALL,
    f"""SELECT id_site, {PK}, count(*) AS rows FROM f_interactions i
        WHERE NOT EXISTS (SELECT 1 FROM f_resources r WHERE r.code_module = i.code_module
              AND r.code_presentation = i.code_presentation AND r.id_site = i.id_site)
        GROUP BY id_site, {PK}""",
    **FAULTY,
)
add(
    "qc_activity_without_attempts",
    ALL,
    f"""SELECT {AK}, count(*) AS rows FROM f_interactions i
        WHERE NOT EXISTS (SELECT 1 FROM f_info a WHERE a.code_module = i.code_module
              AND a.code_presentation = i.code_presentation AND a.id_student = i.id_student)
        GROUP BY {AK}""",
    **FAULTY,
)

# --- marts -------------------------------------------------------------------

add("mart_weekly_engagement", "weekly", "SELECT * FROM weekly")
add(
    "mart_assessment_progress",
    "progress",
    """SELECT * REPLACE (weight::DOUBLE AS weight, score::DOUBLE AS score,
                         is_banked::INTEGER AS is_banked) FROM progress""",
)
add("mart_withdrawal_aligned", "aligned", "SELECT * FROM aligned")
add("mart_course_outcomes", "outcomes", "SELECT * FROM outcomes")
add(
    "mart_resource_usage",
    "interactions resources",
    f"""SELECT {PK}, activity_type, sum(click_count)::BIGINT AS clicks,
               count(DISTINCT id_student) AS active_students
        FROM interactions JOIN resources USING ({PK}, id_site) GROUP BY ALL""",
)
add(
    "exp_overview",
    "courses attempts assessments interactions",
    """SELECT (SELECT count(DISTINCT code_module) FROM courses) AS modules,
              (SELECT count(*) FROM courses) AS module_presentations,
              (SELECT count(DISTINCT id_student) FROM attempts) AS unique_students,
              (SELECT count(*) FROM attempts) AS student_attempts,
              (SELECT count(*) FROM assessments) AS assessments,
              (SELECT count(*) FROM interactions) AS activity_records""",
)
add("exp_weekly_summary", "weekly_summary", "SELECT * FROM weekly_summary")
add(
    "exp_assessment_summary",
    "progress",
    f"""SELECT {PK}, assessment_type, count(*) AS eligible_student_assessments,
               {half_up("sum(missing_submission)", "count(*)", 4)} AS missing_rate,
               {half_up("coalesce(sum((score * 100)::BIGINT), 0)", "100 * count(score)", 2)}
                 AS mean_recorded_score,
               quantile_cont(submission_delay_days, 0.5) AS median_submission_delay_days
        FROM progress GROUP BY {PK}, assessment_type""",
)


def grain(name: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{name}' AS mart, sum(n)::BIGINT AS mart_rows, count(*) AS distinct_keys, "
        f"count(*) FILTER (n > 1) AS repeated_keys "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"
    )


add(
    "grain_checks",
    "weekly progress snapshots",
    " UNION ALL ".join(
        [
            grain("weekly_engagement", "weekly", AKW),
            grain("assessment_progress", "progress", "id_assessment, id_student"),
            grain("model_snapshots", "snapshots", AKW),
        ]
    ),
)

# --- features ----------------------------------------------------------------

add("feat_spine", "spine", "SELECT * FROM spine")
add("feat_padded", "padded", "SELECT * FROM padded")
add("feat_lag", "engagement", f"SELECT {AKW}, clicks_7d, clicks_prior_7d FROM engagement")
add(
    "feat_rolling",
    "engagement",
    f"SELECT {AKW}, clicks_14d, active_days_14d, distinct_sites_14d FROM engagement",
)
add("feat_cumulative", "engagement", f"SELECT {AKW}, clicks_to_date FROM engagement")
add(
    "feat_recency",
    "engagement",
    f"""SELECT {AKW}, latest_feature_day, snapshot_day - latest_feature_day
          AS days_since_activity FROM engagement""",
)
add(
    "feat_change",
    "engagement",
    f"SELECT {AKW}, clicks_7d - clicks_prior_7d AS engagement_change FROM engagement",
)
add(
    "feat_history",
    "state",
    f"""SELECT {AKW}, submissions_to_date, mean_score_to_date, missing_due_to_date,
               weighted_score_to_date FROM state""",
)
add(
    "feat_history_as_of",
    "spine progress",
    f"""SELECT {', '.join('s.' + c.strip() for c in AKW.split(','))},
               count(p.id_assessment) FILTER (p.due_day <= s.snapshot_day
                 AND (p.missing_submission = 1 OR p.submitted_day > s.snapshot_day))
                 AS missing_due_to_date
        FROM spine s LEFT JOIN progress p USING ({AK}) GROUP BY ALL""",
)
add(
    "feat_next_assessment",
    "upcoming",
    f"""SELECT {AKW}, next_assessment_id, next_assessment_due_day, target_next_assessment_event
        FROM upcoming""",
)
add(
    "feat_withdrawal_label",
    "spine attempts",
    f"""SELECT {AKW}, coalesce(unregistration_day BETWEEN snapshot_day + 1 AND snapshot_day + 28,
               false)::INTEGER AS target_withdrawal_28d
        FROM spine JOIN attempts USING ({AK})""",
)
add("feat_model_snapshots", "snapshots", "SELECT * FROM snapshots")
add("snk_snapshots", "snapshots", "SELECT * FROM snapshots")
REGISTRY = [
    ("clicks_7d", "end of snapshot week"),
    ("clicks_prior_7d", "end of prior week"),
    ("clicks_14d", "end of snapshot week"),
    ("clicks_to_date", "end of snapshot week"),
    ("active_days_14d", "end of snapshot week"),
    ("distinct_sites_14d", "end of snapshot week"),
    ("days_since_activity", "end of snapshot week"),
    ("engagement_change", "end of snapshot week"),
    ("submissions_to_date", "day of submission"),
    ("mean_score_to_date", "day of submission"),
    ("missing_due_to_date", "due day"),
    ("weighted_score_to_date", "day of submission"),
    ("target_next_assessment_event", "after the next due day"),
    ("target_withdrawal_28d", "up to 28 days after the snapshot"),
]
add(
    "feat_registry",
    "snapshots",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature_name, '{a}' AS available_at, count({n}) AS known_rows, "
        f"count(*) - count({n}) AS null_rows FROM snapshots"
        for n, a in REGISTRY
    ),
)
add(
    "feat_range_join",
    "spine weekly",
    f"""SELECT {', '.join('s.' + c.strip() for c in AKW.split(','))},
               coalesce(sum(w.click_count), 0)::BIGINT AS clicks_to_week
        FROM spine s
        LEFT JOIN weekly w ON w.code_module = s.code_module
             AND w.code_presentation = s.code_presentation AND w.id_student = s.id_student
             AND w.course_week <= s.course_week
        GROUP BY ALL""",
)
ORACLES["feat_range_join_binned"] = ORACLES["feat_range_join"]
add(
    "feat_snapshot_day",
    "weekly",
    f"SELECT {AKW}, course_week * 7 + 6 AS snapshot_day FROM weekly WHERE course_week >= 0",
)
add(
    "feat_days_since",
    "spine interactions",
    f"""SELECT {AKW}, snapshot_day, snapshot_day - last_day AS days_since FROM (
            SELECT {', '.join('s.' + c.strip() for c in AKW.split(','))}, s.snapshot_day,
                   max(i.activity_day) AS last_day
            FROM spine s
            LEFT JOIN interactions i ON i.code_module = s.code_module
                 AND i.code_presentation = s.code_presentation AND i.id_student = s.id_student
                 AND i.activity_day <= s.snapshot_day
            GROUP BY ALL)""",
)
add(
    "feat_split",
    "scored",
    "SELECT split, code_presentation, count(*) AS snapshots FROM scored GROUP BY ALL",
)
add(
    "feat_leakage_guard",
    "snapshots",
    "SELECT count(*) AS leaking_snapshots FROM snapshots WHERE latest_feature_day > snapshot_day",
)

# --- gallery -----------------------------------------------------------------

GRAIN = {
    "courses": "module-presentation",
    "assessments": "assessment",
    "vle": "module-presentation-site",
    "student_info": "student-module-presentation",
    "student_registration": "student-module-presentation",
    "student_assessment": "student-assessment",
    "student_vle": "student-site-relative-day",
}
add(
    "gal_01",
    ALL,
    " UNION ALL ".join(
        f"SELECT '{t}' AS source_table, count(*) AS rows, '{GRAIN[t]}' AS grain FROM {rel}"
        for t, (rel, _) in RAW.items()
    ),
)
add(
    "gal_02",
    "attempts",
    """SELECT count(*) AS student_module_attempts, count(DISTINCT id_student) AS unique_students,
              count(*) - count(DISTINCT id_student) AS additional_attempt_records FROM attempts""",
)
add("gal_03", "outcomes", "SELECT * FROM outcomes")
add(
    "gal_04",
    "attempts weekly",
    f"""SELECT {AK}, registration_day, unregistration_day, final_result,
               coalesce(sum(click_count), 0)::BIGINT AS total_clicks,
               count(course_week) AS active_weeks
        FROM attempts LEFT JOIN weekly USING ({AK}) GROUP BY ALL
        ORDER BY total_clicks DESC, {AK} LIMIT 100""",
)
add(
    "gal_06",
    "progress",
    f"""SELECT {AK}, count(*) FILTER (missing_submission = 0) AS submitted_assessments,
               count(*) FILTER (missing_submission = 1) AS missing_assessments,
               {half_up("coalesce(sum((score * 100)::BIGINT), 0)", "100 * count(score)", 2)}
                 AS mean_score,
               {half_up("sum((coalesce(score, 0) * 100)::BIGINT * (weight * 100)::BIGINT)",
                        "1000000", 2)} AS weighted_progress
        FROM progress GROUP BY {AK} ORDER BY {AK} LIMIT 100""",
)
WEEKS = "course_week BETWEEN 0 AND 12"
add("gal_07", "weekly", f"SELECT * FROM weekly WHERE {WEEKS} ORDER BY {AKW} LIMIT 100")
PREVIOUS = f"""SELECT {AKW}, click_count,
               lag(click_count) OVER (PARTITION BY {AK} ORDER BY course_week)
                 AS previous_observed_week_clicks
        FROM weekly WHERE {WEEKS}"""
add("gal_08", "weekly", f"{PREVIOUS} ORDER BY {AKW} LIMIT 100")
add("gal_08_all", "weekly", PREVIOUS)
ROLLING = f"""SELECT {AKW}, sum(click_count) OVER (PARTITION BY {AK} ORDER BY course_week
               ROWS 1 PRECEDING)::BIGINT AS rolling_14_day_clicks
        FROM weekly WHERE {WEEKS}"""
add("gal_09", "weekly", f"{ROLLING} ORDER BY {AKW} LIMIT 100")
add("gal_09_all", "weekly", ROLLING)
RANK = f"""SELECT {AKW}, click_count,
               round(percent_rank() OVER (PARTITION BY {PK}, course_week ORDER BY click_count), 6)
                 AS cohort_activity_percentile
        FROM weekly WHERE {WEEKS}"""
add(
    "gal_10",
    "weekly",
    f"""SELECT * FROM r ORDER BY {PK}, course_week, cohort_activity_percentile DESC, id_student
        LIMIT 100""",
    r=RANK,
)
add("gal_10_all", "weekly", RANK)
add(
    "gal_11",
    "interactions",
    f"""SELECT {AK}, max(gap)::INTEGER AS longest_observed_gap_days FROM (
            SELECT {AK}, activity_day - lag(activity_day) OVER (PARTITION BY {AK}
                   ORDER BY activity_day) AS gap
            FROM (SELECT DISTINCT {AK}, activity_day FROM interactions))
        GROUP BY {AK} ORDER BY longest_observed_gap_days DESC NULLS LAST, {AK} LIMIT 100""",
)
add(
    "gal_12",
    "aligned",
    f"""SELECT floor(days_relative_to_unregistration / 7.0)::INTEGER AS weeks_from_unregistration,
               count(DISTINCT ({AK})) AS withdrawing_attempts,
               quantile_cont(click_count, 0.5) AS median_clicks
        FROM aligned WHERE days_relative_to_unregistration BETWEEN -84 AND 28 GROUP BY 1""",
)
add(
    "gal_13",
    "progress",
    f"""SELECT {AK}, due_day,
               sum((coalesce(score, 0) * 100)::BIGINT * (weight * 100)::BIGINT)
                 OVER (PARTITION BY {AK} ORDER BY due_day, id_assessment)::DOUBLE / 1000000
                 AS cumulative_weighted_progress
        FROM progress ORDER BY {AK}, due_day, id_assessment LIMIT 100""",
)
add(
    "gal_13_all",
    "progress",
    f"""SELECT {AK}, due_day, id_assessment,
               sum((coalesce(score, 0) * 100)::BIGINT * (weight * 100)::BIGINT)
                 OVER (PARTITION BY {AK} ORDER BY due_day, id_assessment)::DOUBLE / 1000000
                 AS cumulative_weighted_progress
        FROM progress""",
)
add("gal_14", "snapshots", f"SELECT * FROM snapshots ORDER BY {AKW} LIMIT 100")
ORACLES["gal_15_json"] = """SELECT event_type, json_extract_string(props, '$.k') AS json_value,
       count(*) AS rows FROM events GROUP BY 1, 2"""

# --- course ------------------------------------------------------------------

add(
    "crs_courses",
    "courses",
    f"""SELECT {PK}, presentation_length_days::VARCHAR AS module_presentation_length
        FROM courses ORDER BY {PK} LIMIT 5""",
)
add(
    "crs_modules",
    "courses",
    """SELECT count(*) AS module_presentation_rows, count(DISTINCT code_module) AS modules
       FROM courses""",
)
add(
    "crs_early_registration",
    "attempts",
    f"""SELECT {AK}, registration_day FROM attempts
        WHERE registration_day < 0 AND code_module IN ('AAA', 'BBB')
        ORDER BY registration_day, {AK} LIMIT 25""",
)
add(
    "crs_first_week",
    "interactions",
    f"""SELECT {AK}, activity_day, click_count FROM interactions
        WHERE activity_day BETWEEN 0 AND 6 AND code_presentation LIKE '2014%'
        ORDER BY {AK}, activity_day, click_count LIMIT 100""",
)
add(
    "crs_registration_timing",
    "attempts",
    """SELECT CASE WHEN registration_day IS NULL THEN 'unknown'
                   WHEN registration_day < 0 THEN 'before course start'
                   WHEN registration_day BETWEEN 0 AND 13 THEN 'first two weeks'
                   ELSE 'later' END AS registration_timing, count(*) AS attempts
       FROM attempts GROUP BY 1""",
)
add(
    "crs_result_share",
    "attempts",
    f"""SELECT final_result, attempts, {half_up("100 * attempts", "total", 1)}
                 AS percent_of_attempts
        FROM (SELECT final_result, count(*) AS attempts, sum(count(*)) OVER () AS total
              FROM attempts GROUP BY final_result)""",
)
add(
    "crs_score_summary",
    "submissions",
    f"""SELECT count(score) AS recorded_scores, min(score)::DOUBLE AS minimum_score,
               max(score)::DOUBLE AS maximum_score,
               {half_up("sum((score * 100)::BIGINT)", "100 * count(score)", 2)} AS mean_score
        FROM submissions""",
)
add(
    "crs_large_presentations",
    "attempts",
    f"SELECT {PK}, count(*) AS attempts FROM attempts GROUP BY {PK} HAVING count(*) >= 280",
)
add(
    "crs_attempts_per_student",
    "attempts",
    """SELECT count(*) FILTER (n = 1) AS one_attempt, count(*) FILTER (n > 1) AS multiple_attempts,
              max(n) AS maximum_attempts
       FROM (SELECT count(*) AS n FROM attempts GROUP BY id_student)""",
)
add(
    "crs_registration_range",
    "registration",
    """SELECT count(*) AS registration_records,
              count(unregistration_day) AS recorded_withdrawal_dates,
              min(unregistration_day) AS earliest_relative_day,
              max(unregistration_day) AS latest_relative_day FROM registration""",
)
add(
    "crs_assessment_types",
    "assessments",
    """SELECT assessment_type, count(*) AS assessments,
              count(*) FILTER (due_day IS NULL) AS missing_due_dates
       FROM assessments GROUP BY 1""",
)
add(
    "crs_activity_profile",
    "interactions",
    """SELECT count(*) AS activity_rows, count(*) FILTER (activity_day < 0) AS pre_start_rows,
              min(activity_day) AS earliest_day, max(activity_day) AS latest_day
       FROM interactions""",
)
add(
    "crs_fail_withdrawn",
    "attempts",
    f"""SELECT id_student, {PK}, final_result FROM attempts
        WHERE final_result IN ('Fail', 'Withdrawn') ORDER BY {AK} LIMIT 25""",
)
add(
    "crs_module_results",
    "attempts",
    """SELECT code_module, final_result, count(*) AS attempts FROM attempts
       GROUP BY 1, 2 HAVING count(*) >= 100""",
)
add(
    "crs_missing_share",
    "attempts",
    f"""SELECT count(*) AS attempts, count(imd_band) AS recorded_imd_band,
               count(*) - count(imd_band) AS missing_imd_band,
               {half_up("100 * (count(*) - count(imd_band))", "count(*)", 1)} AS missing_pct
        FROM attempts""",
)
add(
    "crs_repeat_students",
    "attempts",
    """SELECT id_student, count(*) AS attempt_count, count(DISTINCT code_module) AS module_count
       FROM attempts GROUP BY 1 HAVING count(*) > 1
       ORDER BY attempt_count DESC, id_student LIMIT 25""",
)
add(
    "crs_duplicate_keys",
    ALL,
    f"SELECT {AK}, count(*) AS rows_at_key FROM f_info GROUP BY {AK} HAVING count(*) > 1",
    **FAULTY,
)

# --- analysis ----------------------------------------------------------------

add(
    "ana_outcomes",
    "attempts",
    """SELECT position, v.final_result, count(a.id_student) AS attempts
       FROM (VALUES (0, 'Distinction'), (1, 'Pass'), (2, 'Fail'), (3, 'Withdrawn'))
              AS v(position, final_result)
       LEFT JOIN attempts a ON a.final_result = v.final_result GROUP BY 1, 2""",
)
MEDIANS = """SELECT course_week, round(quantile_cont(median_clicks, 0.5), 6) AS median_clicks,
              round(quantile_cont(p75_clicks, 0.5), 6) AS p75_clicks
       FROM weekly_summary GROUP BY 1"""
add("ana_weekly_median", "weekly_summary", MEDIANS)
add(
    "ana_consistency",
    "attempts weekly",
    f"""SELECT final_result, {AK},
               round(sum(click_count)::DOUBLE / count(*), 6) AS mean_weekly_clicks,
               count(*)::INTEGER AS active_weeks
        FROM attempts JOIN weekly USING ({AK}) WHERE {WEEKS} GROUP BY ALL""",
)
PATTERNS = f"""SELECT {PK}, round(avg(missing_submission), 6) AS missing_rate,
               quantile_cont(submission_delay_days, 0.5) AS median_submission_delay_days,
               count(*) AS eligible_student_assessments
        FROM progress GROUP BY {PK}"""
add(
    "ana_assessment_patterns",
    "progress",
    "SELECT * FROM p WHERE median_submission_delay_days IS NOT NULL",
    p=PATTERNS,
)


def extreme(fact: str, measure: str, order: str) -> str:
    return (
        f"SELECT * FROM (SELECT '{fact}' AS fact, {PK}, {measure} AS value FROM p "
        f"WHERE {measure} IS NOT NULL ORDER BY {measure} {order}, {PK} LIMIT 1)"
    )


add(
    "ana_extremes",
    "progress",
    " UNION ALL ".join(
        [
            extreme("lowest missing rate", "missing_rate", "ASC"),
            extreme("highest missing rate", "missing_rate", "DESC"),
            extreme("earliest timing", "median_submission_delay_days", "ASC"),
            extreme("latest timing", "median_submission_delay_days", "DESC"),
        ]
    ),
    p=PATTERNS,
)
TOTALS = """SELECT {}, sum(click_count)::BIGINT AS clicks FROM {} GROUP BY ALL"""
add(
    "ana_weekly_from_fact",
    "interactions",
    TOTALS.format(
        f"{PK}, floor(activity_day / 7.0)::INTEGER AS course_week",
        "(SELECT * FROM interactions WHERE activity_day BETWEEN 0 AND 90)",
    ),
)
add(
    "ana_weekly_from_mart",
    "weekly",
    TOTALS.format(f"{PK}, course_week", f"(SELECT * FROM weekly WHERE {WEEKS})"),
)

add(
    "ana_pairs",
    "interactions weekly spine",
    " UNION ALL ".join(
        f"SELECT '{question}' AS question, '{variant}' AS variant, (SELECT count(*) FROM {rows}) AS rows, 0 AS differing"
        for question, variant, rows in [
            ("weekly totals", "fact", f"""(SELECT DISTINCT {PK}, floor(activity_day / 7.0) FROM interactions
                                           WHERE activity_day BETWEEN 0 AND 90)"""),
            ("weekly totals", "mart", f"(SELECT DISTINCT {PK}, course_week FROM weekly WHERE {WEEKS})"),
            ("clicks to week", "running sum", "spine"),
            ("clicks to week", "binned intervals", "spine"),
            ("clicks to week", "equi-join", "spine"),
        ]
    ),
)
add("ana_snapshots_from_store", "snapshots", f"SELECT {AKW}, clicks_to_date FROM snapshots")
add(
    "snk_results",
    "attempts weekly_summary progress aligned",
    f"""SELECT 'outcome_distribution' AS table_name, 4::BIGINT AS rows
        UNION ALL SELECT 'weekly_engagement_summary', count(*) FROM weekly_summary
        UNION ALL SELECT 'assessment_patterns', count(*) FROM p
        UNION ALL SELECT 'withdrawal_alignment',
                  count(DISTINCT floor(days_relative_to_unregistration / 7.0))
                  FROM aligned WHERE days_relative_to_unregistration BETWEEN -84 AND 28""",
    p=PATTERNS,
)

# --- preprocessing and baselines --------------------------------------------

add(
    "ml_impute_numeric",
    "scored",
    f"""SELECT {AKW},
               round(coalesce(days_since_activity::DOUBLE,
                 (SELECT quantile_cont(days_since_activity::DOUBLE, 0.5) FROM tr)), 6)
                 AS days_since_activity,
               round(coalesce(mean_score_to_date,
                 (SELECT quantile_cont(mean_score_to_date, 0.5) FROM tr)), 6)
                 AS mean_score_to_date
        FROM scored WHERE split = 'test'""",
    tr="SELECT * FROM scored WHERE split = 'train'",
)


def scaled(column: str) -> str:
    return (
        f"round(({column} - (SELECT avg({column}) FROM tr)) / "
        f"(SELECT CASE WHEN stddev_pop({column}) = 0 THEN 1 ELSE stddev_pop({column}) END "
        f"FROM tr), 5) AS {column}"
    )


add(
    "ml_scale",
    "scored",
    f"""SELECT {AKW}, {scaled("clicks_7d")}, {scaled("clicks_to_date")},
               {scaled("engagement_change")} FROM scored WHERE split = 'test'""",
    tr="SELECT * FROM scored WHERE split = 'train'",
)
add(
    "ml_impute_mode",
    "scored",
    f"""SELECT {AKW}, coalesce(imd_band, (SELECT imd_band FROM scored
               WHERE split = 'train' AND imd_band IS NOT NULL GROUP BY imd_band
               ORDER BY count(*) DESC, imd_band LIMIT 1)) AS imd_band
        FROM scored WHERE split = 'test'""",
)
add(
    "ml_one_hot",
    "scored",
    f"""SELECT {AKW}, (SELECT string_agg(CASE WHEN k.code_module = s.code_module AND s.id_student % 10 <> 0
                                              THEN '1' ELSE '0' END, '' ORDER BY k.code_module)
                       FROM known k) AS hot
        FROM scored s WHERE split = 'test'""",
    known="SELECT DISTINCT code_module FROM scored WHERE split = 'train'",
)
add(
    "ml_class_weights",
    "scored",
    """SELECT y AS label, count(*) AS rows,
              round((SELECT count(*) FROM scored WHERE split = 'train')::DOUBLE
                    / (2 * count(*)), 6) AS weight
       FROM scored WHERE split = 'train' GROUP BY y""",
)
add(
    "ml_prevalence",
    "scored",
    f"""SELECT {AKW}, round((SELECT avg(y) FROM scored WHERE split = 'train'), 6) AS probability
        FROM scored WHERE split = 'test'""",
)
add(
    "ml_rule",
    "scored",
    f"""SELECT {AKW}, (days_since_activity IS NULL OR missing_due_to_date > 0
                 OR engagement_change < 0
                 OR days_since_activity > (SELECT quantile_cont(days_since_activity, 0.75)
                    FROM scored WHERE split = 'train'))::INTEGER::DOUBLE AS probability
        FROM scored WHERE split = 'test'""",
)
add(
    "run_metadata",
    "scored",
    """SELECT 'next assessment is never handed in or scores below the pass mark' AS target,
       'missing_due_to_date counts due assessments that are never handed in' AS missing_rule,
       (SELECT string_agg(DISTINCT code_presentation, ',' ORDER BY code_presentation)
        FROM scored WHERE split = 'train') AS train,
       (SELECT string_agg(DISTINCT code_presentation, ',' ORDER BY code_presentation)
        FROM scored WHERE split = 'validation') AS validation,
       (SELECT string_agg(DISTINCT code_presentation, ',' ORDER BY code_presentation)
        FROM scored WHERE split = 'test') AS test,
       (SELECT quantile_cont(days_since_activity, 0.75) FROM scored WHERE split = 'train')::DOUBLE
         AS rule_inactivity_threshold_days,
       20260723 AS random_seed""",
)

ORACLES["ml_tree_splits"] = exact_splits()
ORACLES["ml_boosted_leaves"] = boosted_leaves()
ORACLES["ml_newton"] = newton()
ORACLES["ml_calibrated_mean"] = calibrated_mean()

# --- evaluation --------------------------------------------------------------

CONFUSION = """SELECT {by}, count(*) FILTER (probability < 0.5 AND y = 0) AS true_negative,
       count(*) FILTER (probability >= 0.5 AND y = 0) AS false_positive,
       count(*) FILTER (probability < 0.5 AND y = 1) AS false_negative,
       count(*) FILTER (probability >= 0.5 AND y = 1) AS true_positive
     FROM {source} GROUP BY ALL"""


def ratio(n: str, d: str) -> str:
    return f"round(CASE WHEN ({d}) = 0 THEN 0 ELSE ({n})::DOUBLE / ({d}) END, 6)"


RATES = f"""true_negative + false_positive + false_negative + true_positive AS n,
    {ratio("false_negative + true_positive",
           "true_negative + false_positive + false_negative + true_positive")} AS prevalence,
    {ratio("true_positive", "true_positive + false_positive")} AS precision,
    {ratio("true_positive", "true_positive + false_negative")} AS recall,
    {ratio("2 * true_positive", "2 * true_positive + false_positive + false_negative")} AS f1,
    {ratio("true_positive + true_negative",
           "true_negative + false_positive + false_negative + true_positive")} AS accuracy,
    {ratio("true_positive + false_positive",
           "true_negative + false_positive + false_negative + true_positive")} AS flag_rate"""
MS = "model, split"
add("eva_confusion", "scored", CONFUSION.format(by=MS, source="scored"))
add(
    "eva_threshold_metrics",
    "scored",
    f"SELECT {MS}, {RATES} FROM c",
    c=CONFUSION.format(by=MS, source="scored"),
)


def roc(by: str, source: str) -> str:
    """Area as the rank statistic: mean rank of the positives, ties averaged."""
    return f"""SELECT {by}, count(*) AS n,
        round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)
              / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc
      FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY probability)
                   + (count(*) OVER (PARTITION BY {by}, probability) - 1) / 2.0 AS r
            FROM {source})
      GROUP BY {by}"""


def average_precision(by: str, source: str) -> str:
    """Sum over distinct scores of recall gained times precision, rows at or above each score."""
    return f"""SELECT {by}, sum(tp + fp)::BIGINT AS n,
        round(sum(tp / nullif(events, 0) * hits / seen), 6) AS pr_auc
      FROM (SELECT *, sum(tp) OVER down AS hits, sum(tp + fp) OVER down AS seen,
                   sum(tp) OVER (PARTITION BY {by}) AS events
            FROM (SELECT {by}, probability, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS fp
                  FROM {source} GROUP BY {by}, probability)
            WINDOW down AS (PARTITION BY {by} ORDER BY probability DESC))
      GROUP BY {by}"""


add("eva_roc_auc", "scored", roc(MS, "scored"))
add("eva_average_precision", "scored", average_precision(MS, "scored"))
add(
    "eva_brier",
    "scored",
    f"SELECT {MS}, count(*) AS n, round(avg((probability - y) ** 2), 6) AS brier "
    f"FROM scored GROUP BY {MS}",
)
PREDICTIONS = f"""SELECT {AKW}, snapshot_day, gender, age_band, disability, imd_band,
               next_assessment_due_day, y, probability,
               (probability >= 0.5)::INTEGER AS prediction,
               next_assessment_due_day - snapshot_day AS prediction_horizon_days
        FROM scored"""
add("eva_predictions", "scored", f"{PREDICTIONS} WHERE split = 'test'")
add(
    "eva_calibration_bins",
    "scored",
    """SELECT greatest(1, (SELECT count(*) FROM e WHERE e.edge < t.probability)) AS bin,
              round(avg(probability), 6) AS mean_predicted_probability,
              round(avg(y), 6) AS observed_event_rate, count(*) AS records
       FROM t GROUP BY 1""",
    t="SELECT probability, y FROM scored WHERE split = 'test'",
    e="""SELECT DISTINCT unnest(quantile_cont(probability,
           [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge FROM t""",
)
SWEEP = f"""SELECT threshold, count(*) FILTER (hit) AS records_flagged,
               {ratio("count(*) FILTER (hit)", "count(*)")} AS flag_rate,
               {ratio("count(*) FILTER (hit AND y = 1)", "count(*) FILTER (hit)")} AS precision,
               {ratio("count(*) FILTER (hit AND y = 1)", "count(*) FILTER (y = 1)")} AS recall,
               count(*) FILTER (hit AND y = 1) AS true_alerts,
               count(*) FILTER (hit AND y = 0) AS false_alerts,
               round(count(*) FILTER (hit AND y = 0)::DOUBLE
                     / nullif(count(*) FILTER (hit AND y = 1), 0), 6)
                 AS false_alerts_per_true_alert,
               quantile_cont(lead, 0.5) FILTER (hit AND y = 1) AS median_true_alert_lead_days
        FROM (SELECT y, round(threshold, 6) AS threshold,
                     probability >= threshold AS hit,
                     next_assessment_due_day - snapshot_day AS lead
              FROM {{source}}, (SELECT 0.1::DOUBLE + unnest(range(0, 17)) * 0.05::DOUBLE
                                  AS threshold))
        GROUP BY threshold"""
add("eva_thresholds", "scored", SWEEP.format(source="t"),
    t="SELECT * FROM scored WHERE split = 'test'")
add(
    "ana_facts",
    f"{ALL} attempts weekly_summary scored",
    """SELECT 'attempts' AS fact, count(*)::DOUBLE AS value FROM attempts
       UNION ALL SELECT 'withdrawal_share',
              round(avg((final_result = 'Withdrawn')::INTEGER), 6) FROM attempts
       UNION ALL SELECT 'failed_error_checks',
              count(*) FILTER (severity = 'error' AND status = 'fail')::DOUBLE FROM r
       UNION ALL SELECT 'flagged_at_half', records_flagged::DOUBLE FROM s WHERE threshold = 0.5
       UNION ALL SELECT 'flag_rate_at_half', flag_rate FROM s WHERE threshold = 0.5
       UNION ALL SELECT 'precision_at_half', precision FROM s WHERE threshold = 0.5
       UNION ALL SELECT 'recall_at_half', recall FROM s WHERE threshold = 0.5
       UNION ALL SELECT 'median_clicks_week_' || course_week, median_clicks FROM m
                 WHERE course_week IN (0, 2, 12)""",
    r=results(1, core_counts()),
    s=SWEEP.format(source="scored"),
    m=MEDIANS,
)
LONG = """SELECT y, probability, unnest([
             {'dimension': 'course_week', 'group': course_week::VARCHAR},
             {'dimension': 'code_module', 'group': code_module},
             {'dimension': 'code_presentation', 'group': code_presentation},
             {'dimension': 'gender', 'group': gender},
             {'dimension': 'age_band', 'group': age_band}], recursive := true)
          FROM t"""
DG = 'dimension, "group"'
GROUPED = dict(
    l=LONG,
    c=CONFUSION.format(by=DG, source="l"),
    a=roc(DG, "l"),
    p=average_precision(DG, "l"),
    b=f"SELECT {DG}, round(avg((probability - y) ** 2), 6) AS brier FROM l GROUP BY ALL",
)
add(
    "eva_grouped",
    "scored",
    f"""SELECT {DG}, {RATES}, roc_auc, pr_auc, brier
        FROM c JOIN (SELECT {DG}, roc_auc FROM a) USING ({DG})
               JOIN (SELECT {DG}, pr_auc FROM p) USING ({DG}) JOIN b USING ({DG})
        WHERE true_negative + false_positive + false_negative + true_positive >= 100
          AND roc_auc IS NOT NULL""",
    t="SELECT * FROM scored WHERE split = 'test'",
    **GROUPED,
)
add(
    "ana_metric_by_week",
    "scored",
    """SELECT "group"::INTEGER AS course_week, pr_auc, brier
       FROM p JOIN b USING (dimension, "group") WHERE dimension = 'course_week'""",
    t="SELECT * FROM scored",
    **GROUPED,
)


# --- permuted rows and the saved contract ---------------------------------------


def _feistel(x: str) -> str:
    """The grid's place of ``x`` after the rounds, nested selects that each change a coordinate."""
    inner = f"SELECT *, {x} // b AS l0, {x} % b AS r0"
    source = "FROM step_input"
    for i in range(ROUNDS):
        of, at, f = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        old, mixed = f"{of}{i}", f"{at}{i}"
        hashed = f"(({mixed} + k{i}) % {PRIME})"
        new = f"({old} + ({hashed} * {hashed} % {PRIME} * {FACTOR} + k{i}) % {PRIME}) % {f} AS {of}{i + 1}"
        same = f"{at}{i} AS {at}{i + 1}"
        inner = f"{inner} {source}" if i == 0 else inner
        inner = f"SELECT *, {new}, {same} FROM ({inner})"
    return f"SELECT * EXCLUDE ({', '.join(f'l{i}, r{i}' for i in range(ROUNDS + 1))}), l{ROUNDS} * b + r{ROUNDS} AS y FROM ({inner})"


def _draws() -> str:
    rows = [
        f"('{f}', {r}, {', '.join(f'{k}::BIGINT' for k in round_keys(RANDOM_SEED, f'{f}:{r}'))})"
        for f in ("clicks_to_date", "clicks_7d")
        for r in range(2)
    ]
    return f"(VALUES {', '.join(rows)}) AS d(feature, repeat, {', '.join(f'k{i}' for i in range(ROUNDS))})"


add(
    "ml_permuted_rows",
    "scored",
    f"""SELECT {AKW}, row, feature, repeat, y AS donor FROM (
        WITH RECURSIVE walk AS (
            {_feistel("row").replace("step_input", f"(SELECT * FROM numbered, grid, {_draws()})")}
            UNION ALL
            {_feistel("y0").replace("step_input", "(SELECT * EXCLUDE (y), y AS y0 FROM walk WHERE y >= n)").replace("* EXCLUDE (l0", "* EXCLUDE (y0, l0")}
        ) SELECT * FROM walk WHERE y < n)""",
    numbered=f"""SELECT {AKW}, row_number() OVER (ORDER BY
                   substr(md5(concat_ws('|', {AKW}, {RANDOM_SEED})), 1, 13), {AKW}) - 1 AS row
                 FROM scored WHERE split = 'test'""",
    root="SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS s FROM numbered",
    grid=f"""SELECT n, a, (n + a - 1) // a AS b
             FROM (SELECT n, unnest(range(greatest((s + 1) // 2, s - {TRIED - 1}), s + 1)) AS a FROM root)
             ORDER BY a * ((n + a - 1) // a) - n, a DESC LIMIT 1""",
)
add(
    "ml_reloaded",
    "scored",
    f"""SELECT {PK}, count(*) AS rows, count(*) AS same,
               'clicks_7d is missing; clicks_to_date is string instead of bigint' AS faults
        FROM scored WHERE split = 'test' GROUP BY {PK}""",
)
