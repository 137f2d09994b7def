"""The teaching queries of the course, on attempts and source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courselake.functions.columns import exact_mean, exact_ratio, nulls_last
from courselake.operators.constraints import primary_key
from courselake.schemas import ATTEMPT, PRESENTATION


def _rows() -> Column:
    return F.count(F.lit(1))


def first_courses(raw_courses: DataFrame, n: int = 5) -> DataFrame:
    return (
        raw_courses.select(*PRESENTATION, "module_presentation_length")
        .orderBy(*nulls_last(*PRESENTATION))
        .limit(n)
    )


def modules_and_presentations(raw_courses: DataFrame) -> DataFrame:
    return raw_courses.agg(
        _rows().alias("module_presentation_rows"),
        F.count_distinct("code_module").alias("modules"),
    )


def early_registration(
    attempts: DataFrame, modules: tuple[str, ...] = ("AAA", "BBB"), n: int = 25
) -> DataFrame:
    """Attempts registered before the start in the given modules, earliest first."""
    return (
        attempts.filter((F.col("registration_day") < 0) & F.col("code_module").isin(*modules))
        .select(*ATTEMPT, "registration_day")
        .orderBy("registration_day", *ATTEMPT)
        .limit(n)
    )


def first_week_activity(interactions: DataFrame, n: int = 100) -> DataFrame:
    """Activity of days 0 to 6 in presentations of 2014."""
    return (
        interactions.filter(
            F.col("activity_day").between(0, 6) & F.col("code_presentation").like("2014%")
        )
        .select(*ATTEMPT, "activity_day", "click_count")
        .orderBy(*ATTEMPT, "activity_day", "click_count")
        .limit(n)
    )


def registration_timing(attempts: DataFrame) -> DataFrame:
    """Attempts per registration band; an unknown day has its own band."""
    day = F.col("registration_day")
    band = (
        F.when(day.isNull(), "unknown")
        .when(day < 0, "before course start")
        .when(day <= 13, "first two weeks")
        .otherwise("later")
    )
    return (
        attempts.groupBy(band.alias("registration_timing"))
        .agg(_rows().alias("attempts"))
        .orderBy(F.desc("attempts"), "registration_timing")
    )


def result_share(attempts: DataFrame) -> DataFrame:
    """Attempts per result and their share of all attempts."""
    counts = attempts.groupBy("final_result").agg(_rows().alias("attempts"))
    total = counts.agg(F.sum("attempts")).scalar()
    return counts.select(
        "final_result",
        "attempts",
        exact_ratio(100 * F.col("attempts"), total, 1).alias("percent_of_attempts"),
    ).orderBy(F.desc("attempts"), "final_result")


def score_summary(submissions: DataFrame) -> DataFrame:
    return submissions.agg(
        F.count("score").alias("recorded_scores"),
        F.min("score").alias("minimum_score"),
        F.max("score").alias("maximum_score"),
        exact_mean("score", 2).alias("mean_score"),
    )


def large_presentations(attempts: DataFrame, at_least: int = 1000) -> DataFrame:
    return (
        attempts.groupBy(*PRESENTATION)
        .agg(_rows().alias("attempts"))
        .filter(F.col("attempts") >= at_least)
        .orderBy(F.desc("attempts"), *PRESENTATION)
    )


def attempts_per_student(attempts: DataFrame) -> DataFrame:
    """Students with one and with several attempts."""
    per_student = attempts.groupBy("id_student").agg(_rows().alias("attempts"))
    return per_student.agg(
        F.count_if(F.col("attempts") == 1).alias("one_attempt"),
        F.count_if(F.col("attempts") > 1).alias("multiple_attempts"),
        F.max("attempts").alias("maximum_attempts"),
    )


def registration_range(registration: DataFrame) -> DataFrame:
    return registration.agg(
        _rows().alias("registration_records"),
        F.count("unregistration_day").alias("recorded_withdrawal_dates"),
        F.min("unregistration_day").alias("earliest_relative_day"),
        F.max("unregistration_day").alias("latest_relative_day"),
    )


def assessment_types(assessments: DataFrame) -> DataFrame:
    return (
        assessments.groupBy("assessment_type")
        .agg(
            _rows().alias("assessments"),
            F.count_if(F.col("due_day").isNull()).alias("missing_due_dates"),
        )
        .orderBy("assessment_type")
    )


def activity_profile(interactions: DataFrame) -> DataFrame:
    return interactions.agg(
        _rows().alias("activity_rows"),
        F.count_if(F.col("activity_day") < 0).alias("pre_start_rows"),
        F.min("activity_day").alias("earliest_day"),
        F.max("activity_day").alias("latest_day"),
    )


def failed_or_withdrawn(attempts: DataFrame, n: int = 25) -> DataFrame:
    return (
        attempts.filter(F.col("final_result").isin("Fail", "Withdrawn"))
        .select("id_student", *PRESENTATION, "final_result")
        .orderBy(*ATTEMPT)
        .limit(n)
    )


def module_results(attempts: DataFrame, at_least: int = 100) -> DataFrame:
    return (
        attempts.groupBy("code_module", "final_result")
        .agg(_rows().alias("attempts"))
        .filter(F.col("attempts") >= at_least)
        .orderBy("code_module", F.desc("attempts"), "final_result")
    )


def missing_share(attempts: DataFrame) -> DataFrame:
    """Attempts with and without a deprivation band."""
    missing = F.count_if(F.col("imd_band").isNull())
    return attempts.agg(
        _rows().alias("attempts"),
        F.count("imd_band").alias("recorded_imd_band"),
        missing.alias("missing_imd_band"),
        exact_ratio(100 * missing, _rows(), 1).alias("missing_pct"),
    )


def repeat_students(attempts: DataFrame, n: int = 25) -> DataFrame:
    """Students with several attempts and their number of modules."""
    return (
        attempts.groupBy("id_student", "code_module")
        .agg(_rows().alias("attempts"))
        .groupBy("id_student")
        .agg(F.sum("attempts").alias("attempt_count"), _rows().alias("module_count"))
        .filter(F.col("attempt_count") > 1)
        .orderBy(F.desc("attempt_count"), "id_student")
        .limit(n)
    )


def duplicate_keys(student_info: DataFrame) -> DataFrame:
    """Attempt keys with more than one row."""
    return primary_key(student_info, ATTEMPT).withColumnRenamed("rows", "rows_at_key")
