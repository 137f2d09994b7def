"""Typed staging tables: trim, blank the missing marker, cast. Map-only jobs.

A cell that cannot be cast stops the job (ANSI casts). ``quarantine`` is the way
to keep going: it splits rows into typed ones and rejected ones with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cell:
    """How one staging column comes from its landing column."""

    name: str
    source: str
    type: str = "string"
    trim: bool = False
    optional: bool = False

    def text(self) -> Column:
        value = F.col(self.source)
        if self.trim:
            value = F.trim(value)
        return F.nullif(value, F.lit("?")) if self.optional else value

    def typed(self, attempt: bool = False) -> Column:
        value = self.text()
        if self.type == "string":
            return value
        steps = ["int", "boolean"] if self.type == "boolean" else [self.type]
        for step in steps:
            value = value.try_cast(step) if attempt else value.cast(step)
        return value


def _key(name: str) -> Cell:
    return Cell(name, name, trim=True)


def _int(name: str, source: str | None = None, optional: bool = False) -> Cell:
    return Cell(name, source or name, "int", optional=optional)


STAGING: dict[str, list[Cell]] = {
    "courses": [
        _key("code_module"),
        _key("code_presentation"),
        _int("presentation_length_days", "module_presentation_length"),
    ],
    "assessments": [
        _key("code_module"),
        _key("code_presentation"),
        _int("id_assessment"),
        _key("assessment_type"),
        _int("due_day", "date", optional=True),
        Cell("weight", "weight", "decimal(6,2)"),
    ],
    "vle": [
        _int("id_site"),
        _key("code_module"),
        _key("code_presentation"),
        _key("activity_type"),
        _int("week_from", optional=True),
        _int("week_to", optional=True),
    ],
    "student_info": [
        _key("code_module"),
        _key("code_presentation"),
        _int("id_student"),
        _key("gender"),
        _key("region"),
        _key("highest_education"),
        Cell("imd_band", "imd_band", optional=True),  # deliberately not trimmed
        _key("age_band"),
        _int("previous_attempts", "num_of_prev_attempts"),
        _int("studied_credits"),
        _key("disability"),
        _key("final_result"),
    ],
    "student_registration": [
        _key("code_module"),
        _key("code_presentation"),
        _int("id_student"),
        _int("registration_day", "date_registration", optional=True),
        _int("unregistration_day", "date_unregistration", optional=True),
    ],
    "student_assessment": [
        _int("id_assessment"),
        _int("id_student"),
        _int("submitted_day", "date_submitted"),
        Cell("is_banked", "is_banked", "boolean"),
        Cell("score", "score", "decimal(5,2)", optional=True),
    ],
    "student_vle": [
        _key("code_module"),
        _key("code_presentation"),
        _int("id_student"),
        _int("id_site"),
        _int("activity_day", "date"),
        _int("click_count", "sum_click"),
    ],
}


def stage(raw: DataFrame, table: str) -> DataFrame:
    """A landing table in staging types."""
    return raw.select(*[c.typed().alias(c.name) for c in STAGING[table]])


def stage_courses(raw: DataFrame) -> DataFrame:
    return stage(raw, "courses")


def stage_assessments(raw: DataFrame) -> DataFrame:
    return stage(raw, "assessments")


def stage_resources(raw: DataFrame) -> DataFrame:
    return stage(raw, "vle")


def stage_student_info(raw: DataFrame) -> DataFrame:
    return stage(raw, "student_info")


def stage_registration(raw: DataFrame) -> DataFrame:
    return stage(raw, "student_registration")


def stage_submissions(raw: DataFrame) -> DataFrame:
    return stage(raw, "student_assessment")


def stage_interactions(raw: DataFrame) -> DataFrame:
    return stage(raw, "student_vle")


def quarantine(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected landing rows with the columns that failed to cast)."""
    cells = STAGING[table]
    reasons = [
        F.when(c.text().isNotNull() & c.typed(attempt=True).isNull(), F.lit(c.source))
        for c in cells
        if c.type != "string"
    ]
    checked = raw.withColumn("reason", F.concat_ws(",", *reasons))
    typed = checked.filter(F.col("reason") == "").select(
        *[c.typed(attempt=True).alias(c.name) for c in cells]
    )
    return typed, checked.filter(F.col("reason") != "")
