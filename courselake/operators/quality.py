"""Quality checks and their framework.

Checks are compiled by ``checking``: a table is scanned once per key that is checked, and its
row checks ride on one of these scans. A result is one row per check; only ``gate`` and the
assertions bring anything to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courselake.operators.checking import Rule, violations
from courselake.operators.constraints import primary_key, unmatched
from courselake.schemas import (
    ASSESSMENT_TARGET,
    ATTEMPT,
    ATTEMPT_WEEK,
    FINAL_RESULTS,
    LAST_WEEK,
    MODULE_CODES,
    PRESENTATION,
    PRESENTATION_CODE_PATTERN,
    RESOURCE,
    SUBMISSION,
    WITHDRAWAL_TARGET,
)

RESULT_COLUMNS = ["run_at", "check_name", "severity", "failing_rows", "status", "detail"]
# Row counts of the published source files.
PUBLISHED_ROWS = {"presentations": 22, "student_info": 32593, "interactions": 10655280}


@dataclass(frozen=True)
class Check:
    """One check: a row condition on a table, an expected row count, a key that may occur
    once, or a key that another table must hold."""

    name: str
    severity: str
    detail: str
    table: str
    condition: Callable[[], Column] | None = None
    expected_rows: int | None = None
    unique: tuple[str, ...] = ()
    parent: str | None = None
    reference: tuple[str, ...] = ()

    def offending(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The failing rows, or the failing keys with their row count."""
        if self.unique:
            return primary_key(tables[self.table], list(self.unique))
        if self.reference:
            return unmatched(tables[self.table], tables[self.parent], list(self.reference))
        if self.condition is not None:
            return tables[self.table].filter(self.condition())
        raise ValueError(f"{self.name} compares a count and has no offending rows")

    def rule(self) -> Rule:
        return Rule(
            self.table, self.name, self.condition, self.expected_rows, self.unique, self.parent, self.reference
        )


def core_checks(expected_rows: dict[str, int] | None = None) -> list[Check]:
    """The checks on the typed source tables."""
    rows = {**PUBLISHED_ROWS, **(expected_rows or {})}
    c = F.col
    error, warning, info = "error", "warning", "informational"
    # Names, severities and bounds of the checks. The details are our words.
    return [
        Check("source_courses_row_count", error, "Presentation rows against the expected number.",
              "presentations", expected_rows=rows["presentations"]),
        Check("source_student_info_row_count", error,
              "Student information rows against the expected number.",
              "student_info", expected_rows=rows["student_info"]),
        Check("source_activity_row_count", error, "Activity rows against the expected number.",
              "interactions", expected_rows=rows["interactions"]),
        Check("duplicate_student_attempts", error, "An attempt key may occur once.",
              "student_info", unique=tuple(ATTEMPT)),
        Check("duplicate_assessment_submissions", error,
              "A student may hand in an assessment once.",
              "submissions", unique=tuple(SUBMISSION)),
        Check("orphan_assessments", error, "An assessment needs its presentation.", "assessments",
              parent="presentations", reference=tuple(PRESENTATION)),
        Check("orphan_submissions", error, "A submission needs its assessment.", "submissions",
              parent="assessments", reference=("id_assessment",)),
        Check("registrations_without_attempts", error, "A registration needs its attempt.",
              "registration",
              parent="student_info", reference=tuple(ATTEMPT)),
        Check("activity_without_resources", error,
              "An activity needs its site in the same presentation.", "interactions",
              parent="resources", reference=tuple(RESOURCE)),
        Check("activity_without_attempts", warning,
              "Activity can exist for students outside the attempt table.", "interactions",
              parent="student_info", reference=tuple(ATTEMPT)),
        Check("invalid_assessment_weights", error, "A weight lies in 0 to 100.", "assessments",
              lambda: ~c("weight").between(0, 100)),
        Check("invalid_score_ranges", error, "A recorded score lies in 0 to 100.", "submissions",
              lambda: ~c("score").between(0, 100)),
        Check("invalid_final_results", error, "A final result is one of the four known ones.",
              "student_info", lambda: ~c("final_result").isin(FINAL_RESULTS)),
        Check("negative_click_counts", error, "Clicks are not negative.", "interactions",
              lambda: c("click_count") < 0),
        Check("registration_after_unregistration", error,
              "Unregistration is not before registration.", "registration",
              lambda: c("unregistration_day") < c("registration_day")),
        Check("unexpected_module_codes", warning, "Module codes run from AAA to GGG.",
              "presentations", lambda: ~c("code_module").isin(MODULE_CODES)),
        Check("unexpected_presentation_codes", warning,
              "Presentation codes are 2013 or 2014 with B or J.", "presentations",
              lambda: ~c("code_presentation").rlike(PRESENTATION_CODE_PATTERN)),
        Check("missing_imd_band", info, "Attempts without a deprivation band.", "student_info",
              lambda: c("imd_band").isNull()),
        Check("missing_assessment_due_dates", info, "Assessments without a due day.",
              "assessments", lambda: c("due_day").isNull()),
        Check("activity_before_course_start", info, "Activity on a negative day is legitimate.",
              "interactions", lambda: c("activity_day") < 0),
    ]


def snapshot_checks(last_week: int = LAST_WEEK) -> list[Check]:
    """The checks on the snapshot mart."""
    c = F.col
    # Names, severities and bounds of the checks.
    return [
        Check("duplicate_model_snapshots", "error", "One snapshot per attempt and week.",
              "snapshots", unique=tuple(ATTEMPT_WEEK)),
        Check("invalid_snapshot_dates", "error",
              "Weeks run from 0 to the last one and end on their seventh day.", "snapshots",
              lambda: ~c("course_week").between(0, last_week)
              | (c("snapshot_day") != c("course_week") * 7 + 6)),
        Check("future_information_in_snapshots", "error",
              "No feature uses activity after the snapshot.", "snapshots",
              lambda: c("latest_feature_day") > c("snapshot_day")),
        Check("invalid_model_targets", "error",
              "Labels are 0 or 1 and the next assessment is due later.", "snapshots",
              lambda: ~c(ASSESSMENT_TARGET).isin(0, 1)
              | ~c(WITHDRAWAL_TARGET).isin(0, 1)
              | (c("next_assessment_due_day") <= c("snapshot_day"))),
    ]


def failing_rows(checks: list[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, severity, failing_rows, detail) of every check."""

    def named(what: Callable[[Check], str]) -> Column:
        pairs = [F.lit(x) for ch in checks for x in (ch.name, what(ch))]
        return F.element_at(F.create_map(*pairs), F.col("rule"))

    return violations([ch.rule() for ch in checks], tables).select(
        F.col("rule").alias("check_name"),
        named(lambda ch: ch.severity).alias("severity"),
        F.col("violations").alias("failing_rows"),
        named(lambda ch: ch.detail).alias("detail"),
    )


def run_checks(
    checks: list[Check], tables: dict[str, DataFrame], run_at: Column | None = None
) -> DataFrame:
    """One result row per check."""
    status = (
        F.when(F.col("severity") == "informational", "profile")
        .when(F.col("failing_rows") == 0, "pass")
        .otherwise("fail")
    )
    return (
        failing_rows(checks, tables)
        .withColumns(
            {"run_at": F.current_timestamp() if run_at is None else run_at, "status": status}
        )
        .select(*RESULT_COLUMNS)
    )


def replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old results with those of the newly run checks replaced."""
    return old.join(new.select("check_name").distinct(), "check_name", "left_anti").select(
        *RESULT_COLUMNS
    ).unionByName(new.select(*RESULT_COLUMNS))


def latest(results: DataFrame) -> DataFrame:
    """The newest result of each check, by severity and name."""
    newest = F.max_by(F.struct(*RESULT_COLUMNS), "run_at").alias("r")
    return (
        results.groupBy("check_name")
        .agg(newest)
        .select("r.*")
        .orderBy("severity", "check_name")
    )


def gate_summary(results: DataFrame) -> DataFrame:
    """One row: error checks that fail, and whether the gate opens."""
    failed = F.count_if((F.col("severity") == "error") & (F.col("status") == "fail"))
    return results.agg(failed.alias("failed_errors")).withColumn(
        "passed", F.col("failed_errors") == 0
    )


def gate(results: DataFrame) -> None:
    """Raise when any error check fails."""
    failed = (
        results.filter((F.col("severity") == "error") & (F.col("status") == "fail"))
        .select("check_name", "failing_rows")
        .collect()
    )
    if failed:
        text = ", ".join(f"{r.check_name} ({r.failing_rows})" for r in failed)
        raise ValueError(f"{len(failed)} error-level quality checks failed: {text}")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise before any job runs when a required column is absent."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"Required columns are missing: {absent}")


def leaking(snapshots: DataFrame) -> DataFrame:
    """Snapshots that use activity after their own day. An unknown day passes."""
    require_columns(snapshots, ["snapshot_day", "latest_feature_day"])
    return snapshots.filter(F.col("latest_feature_day") > F.col("snapshot_day"))


def assert_no_future(snapshots: DataFrame) -> None:
    """Raise when a snapshot holds future information."""
    if leaking(snapshots).limit(1).collect():
        raise ValueError("Snapshots contain future information")
