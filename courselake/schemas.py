"""Names, keys and fixed values shared by every layer."""

from __future__ import annotations

PRESENTATION = ["code_module", "code_presentation"]
ATTEMPT = [*PRESENTATION, "id_student"]
SUBMISSION = ["id_assessment", "id_student"]
RESOURCE = ["id_site", *PRESENTATION]
ATTEMPT_WEEK = [*ATTEMPT, "course_week"]

# The column names of the seven landing files, in file order.
LANDING_COLUMNS = {
    "courses": ["code_module", "code_presentation", "module_presentation_length"],
    "assessments": [
        "code_module", "code_presentation", "id_assessment", "assessment_type", "date", "weight",
    ],
    "vle": [
        "id_site", "code_module", "code_presentation", "activity_type", "week_from", "week_to",
    ],
    "student_info": [
        "code_module", "code_presentation", "id_student", "gender", "region",
        "highest_education", "imd_band", "age_band", "num_of_prev_attempts",
        "studied_credits", "disability", "final_result",
    ],
    "student_registration": [
        "code_module", "code_presentation", "id_student", "date_registration",
        "date_unregistration",
    ],
    "student_assessment": [
        "id_assessment", "id_student", "date_submitted", "is_banked", "score",
    ],
    "student_vle": [
        "code_module", "code_presentation", "id_student", "id_site", "date", "sum_click",
    ],
}

# File name of each landing table.
LANDING_FILES = {
    "courses": "courses.csv",
    "assessments": "assessments.csv",
    "vle": "vle.csv",
    "student_info": "studentInfo.csv",
    "student_registration": "studentRegistration.csv",
    "student_assessment": "studentAssessment.csv",
    "student_vle": "studentVle.csv",
}

# The activity file is the only one that lands typed.
LANDING_TYPES = {
    "student_vle": {"id_student": "int", "id_site": "int", "date": "int", "sum_click": "int"},
}

# Grain stated for each landing table.
LANDING_GRAIN = {
    "courses": "module-presentation",
    "assessments": "assessment",
    "vle": "module-presentation-site",
    "student_info": "student-module-presentation",
    "student_registration": "student-module-presentation",
    "student_assessment": "student-assessment",
    "student_vle": "student-site-relative-day",
}

# Markers that stand for a missing cell in the landing files.
MISSING_MARKERS = ("", "?")

# Accepted codes.
MODULE_CODES = ["AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG"]
PRESENTATION_CODE_PATTERN = "^201[34][BJ]$"
FINAL_RESULTS = ["Distinction", "Pass", "Fail", "Withdrawn"]
ASSESSMENT_TYPES = ["TMA", "CMA", "Exam"]

# Constants of the snapshot and forecast definitions.
LAST_WEEK = 12
PASS_MARK = 40
WITHDRAWAL_HORIZON = 28
RANDOM_SEED = 20260723

# Model inputs and labels.
NUMERIC_FEATURES = [
    "clicks_7d",
    "clicks_prior_7d",
    "clicks_14d",
    "clicks_to_date",
    "active_days_14d",
    "distinct_sites_14d",
    "days_since_activity",
    "engagement_change",
    "submissions_to_date",
    "mean_score_to_date",
    "missing_due_to_date",
    "weighted_score_to_date",
]
CATEGORICAL_FEATURES = ["code_module", "presentation_term"]
ASSESSMENT_TARGET = "target_next_assessment_event"
WITHDRAWAL_TARGET = "target_withdrawal_28d"
DEMOGRAPHICS = ["gender", "age_band", "disability", "imd_band"]


def landing_schema(table: str) -> str:
    """DDL schema of a landing table: text unless declared typed."""
    types = LANDING_TYPES.get(table, {})
    return ", ".join(f"`{c}` {types.get(c, 'string')}" for c in LANDING_COLUMNS[table])
