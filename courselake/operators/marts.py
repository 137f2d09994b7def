"""Analytical marts: weekly engagement, assessment progress, withdrawal alignment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.functions.columns import exact_mean, exact_ratio, week_of
from courselake.schemas import (
    ATTEMPT,
    ATTEMPT_WEEK,
    LAST_WEEK,
    PASS_MARK,
    PRESENTATION,
    RESOURCE,
    SUBMISSION,
)


def weekly_engagement(interactions: DataFrame) -> DataFrame:
    """Activity per attempt and course week, in one grouped pass over the fact table.

    The active days of a week are seven bits OR-ed together. That leaves one
    DISTINCT in the plan (sites), which Spark resolves without multiplying the
    rows, and every aggregate combines before the shuffle.
    """
    weekday_bit = F.expr("shiftleft(1, pmod(activity_day, 7))")
    return (
        interactions.withColumn("course_week", week_of("activity_day"))
        .groupBy(*ATTEMPT_WEEK)
        .agg(
            F.sum("click_count").alias("click_count"),
            F.bit_count(F.bit_or(weekday_bit)).cast("int").alias("active_days"),
            F.count_distinct("id_site").cast("int").alias("distinct_sites"),
            F.max("activity_day").alias("latest_activity_day"),
            F.count(F.lit(1)).alias("source_rows"),
        )
    )


def assessment_progress(
    attempts: DataFrame,
    assessments: DataFrame,
    submissions: DataFrame,
    pass_mark: int = PASS_MARK,
) -> DataFrame:
    """One row per attempt and dated non-exam assessment, submitted or not.

    ``missing_submission`` means no submission row exists at all; a late one is
    not missing. An event is adverse below the pass mark or when missing; a row
    whose score is NULL is not.
    """
    due = assessments.filter(
        (F.col("assessment_type") != "Exam") & F.col("due_day").isNotNull()
    ).select(*PRESENTATION, "id_assessment", "assessment_type", "due_day", "weight")
    handed_in = submissions.select(
        *SUBMISSION, "submitted_day", "score", "is_banked", F.lit(True).alias("handed_in")
    )
    missing = F.col("handed_in").isNull()
    return (
        attempts.select(*ATTEMPT)
        .join(due, PRESENTATION)
        .join(handed_in, SUBMISSION, "left")
        .select(
            *ATTEMPT,
            "id_assessment",
            "assessment_type",
            "due_day",
            "weight",
            "submitted_day",
            "score",
            "is_banked",
            (F.col("submitted_day") - F.col("due_day")).alias("submission_delay_days"),
            F.when(missing, 1).otherwise(0).alias("missing_submission"),
            F.when((F.col("score") < pass_mark) | missing, 1)
            .otherwise(0)
            .alias("adverse_assessment_event"),
        )
    )


def withdrawal_aligned(attempts: DataFrame, weekly: DataFrame) -> DataFrame:
    """Weekly engagement of withdrawn attempts, by days from the unregistration day."""
    withdrawn = attempts.filter(
        (F.col("final_result") == "Withdrawn") & F.col("unregistration_day").isNotNull()
    ).select(*ATTEMPT, "final_result", "unregistration_day")
    return withdrawn.join(
        weekly.select(*ATTEMPT_WEEK, "click_count", "active_days"), ATTEMPT
    ).select(
        *ATTEMPT,
        "final_result",
        "unregistration_day",
        "course_week",
        (F.col("course_week") * 7 - F.col("unregistration_day")).alias(
            "days_relative_to_unregistration"
        ),
        "click_count",
        "active_days",
    )


def course_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts per presentation by final result, and the withdrawal rate."""

    def ended(result: str):
        return F.count_if(F.col("final_result") == result)

    return attempts.groupBy(*PRESENTATION).agg(
        F.count(F.lit(1)).alias("student_attempts"),
        F.count_distinct("id_student").alias("unique_students_within_presentation"),
        ended("Distinction").alias("distinctions"),
        ended("Pass").alias("passes"),
        ended("Fail").alias("fails"),
        ended("Withdrawn").alias("withdrawals"),
        exact_ratio(ended("Withdrawn"), F.count("final_result"), 4).alias("withdrawal_rate"),
    )


def resource_usage(interactions: DataFrame, resources: DataFrame) -> DataFrame:
    """Clicks and active students per activity type.

    The fact table is first reduced to (presentation, site, student), so the join
    with the resources and the distinct count work on reduced rows.
    """
    per_student = interactions.groupBy(*RESOURCE, "id_student").agg(
        F.sum("click_count").alias("clicks")
    )
    return (
        per_student.join(resources.select(*RESOURCE, "activity_type"), RESOURCE)
        .groupBy(*PRESENTATION, "activity_type")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.count_distinct("id_student").alias("active_students"),
        )
    )


def overview(
    presentations: DataFrame, attempts: DataFrame, assessments: DataFrame, interactions: DataFrame
) -> DataFrame:
    """One row of six totals, each a scalar subquery."""

    def rows(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    def distinct(df: DataFrame, column: str):
        return df.agg(F.count_distinct(column)).scalar()

    return presentations.sparkSession.range(1).select(
        distinct(presentations, "code_module").alias("modules"),
        rows(presentations).alias("module_presentations"),
        distinct(attempts, "id_student").alias("unique_students"),
        rows(attempts).alias("student_attempts"),
        rows(assessments).alias("assessments"),
        rows(interactions).alias("activity_records"),
    )


def weekly_summary(weekly: DataFrame, last_week: int = LAST_WEEK) -> DataFrame:
    """Distribution of weekly clicks per presentation and week.

    ``percentile`` is exact and interpolates. It keeps one counter per distinct
    click total, merged before the shuffle, so a group costs its distinct values.
    """
    return (
        weekly.filter(F.col("course_week").between(0, last_week))
        .groupBy(*PRESENTATION, "course_week")
        .agg(
            F.count(F.lit(1)).alias("active_student_attempts"),
            F.percentile("click_count", 0.5).alias("median_clicks"),
            F.percentile("click_count", 0.75).alias("p75_clicks"),
            exact_mean("active_days", 2).cast("decimal(10,2)").alias("mean_active_days"),
        )
    )


def assessment_summary(progress: DataFrame) -> DataFrame:
    """Missing rate, mean score and median delay per presentation and type."""
    return progress.groupBy(*PRESENTATION, "assessment_type").agg(
        F.count(F.lit(1)).alias("eligible_student_assessments"),
        exact_mean("missing_submission", 4).cast("decimal(10,4)").alias("missing_rate"),
        exact_mean("score", 2).cast("decimal(10,2)").alias("mean_recorded_score"),
        F.percentile("submission_delay_days", 0.5).alias("median_submission_delay_days"),
    )


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def grain_report(marts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows, distinct keys and repeated keys of each mart."""
    out = None
    for name, (df, keys) in marts.items():
        counts = (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows"))
            .agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("mart_rows"),
                F.count(F.lit(1)).alias("distinct_keys"),
                F.count_if(F.col("rows") > 1).alias("repeated_keys"),
            )
            .select(F.lit(name).alias("mart"), "mart_rows", "distinct_keys", "repeated_keys")
        )
        out = counts if out is None else out.unionByName(counts)
    return out


def assert_grain(df: DataFrame, keys: list[str]) -> None:
    """Raise when a key repeats."""
    repeated = grain_violations(df, keys).limit(1).collect()
    if repeated:
        raise ValueError(f"Grain {keys} is not unique, for example {repeated[0].asDict()}")
