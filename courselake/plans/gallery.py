"""The fifteen gallery questions over the core tables and marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courselake.functions.columns import exact_mean, nulls_last
from courselake.operators.quality import latest
from courselake.schemas import (
    ATTEMPT,
    ATTEMPT_WEEK,
    LANDING_GRAIN,
    LAST_WEEK,
    PRESENTATION,
)


def _modelled(weekly: DataFrame) -> DataFrame:
    return weekly.filter(F.col("course_week").between(0, LAST_WEEK))


def source_rows(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows and grain of each source table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source_table"), "rows", F.lit(LANDING_GRAIN[name]).alias("grain")
        )
        for name, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("source_table")


def attempts_and_students(attempts: DataFrame) -> DataFrame:
    """Attempt rows against unique students."""
    return attempts.agg(
        F.count(F.lit(1)).alias("student_module_attempts"),
        F.count_distinct("id_student").alias("unique_students"),
    ).withColumn(
        "additional_attempt_records",
        F.col("student_module_attempts") - F.col("unique_students"),
    )


def outcomes_by_presentation(outcomes: DataFrame) -> DataFrame:
    return outcomes.orderBy(F.desc_nulls_first("withdrawal_rate"), *nulls_last(*PRESENTATION))


def busiest_attempts(attempts: DataFrame, weekly: DataFrame, n: int = 100) -> DataFrame:
    """Attempts with the most clicks, their registration and outcome."""
    totals = weekly.groupBy(*ATTEMPT).agg(
        F.sum("click_count").alias("clicks"), F.count("course_week").alias("weeks")
    )
    return (
        attempts.select(*ATTEMPT, "registration_day", "unregistration_day", "final_result")
        .join(totals, ATTEMPT, "left")
        .select(
            *ATTEMPT,
            "registration_day",
            "unregistration_day",
            "final_result",
            F.coalesce("clicks", F.lit(0)).alias("total_clicks"),
            F.coalesce("weeks", F.lit(0)).alias("active_weeks"),
        )
        .orderBy(F.desc("total_clicks"), *ATTEMPT)
        .limit(n)
    )


def quality_results(results: DataFrame) -> DataFrame:
    return latest(results).select("severity", "check_name", "failing_rows", "status", "detail")


def attempt_progress(progress: DataFrame, n: int = 100) -> DataFrame:
    """Submitted and missing assessments, mean score and weighted progress per attempt."""
    weighted = (F.coalesce("score", F.lit(0)) * F.col("weight")).cast("decimal(12,4)")
    return (
        progress.groupBy(*ATTEMPT)
        .agg(
            F.count_if(F.col("missing_submission") == 0).alias("submitted_assessments"),
            F.count_if(F.col("missing_submission") == 1).alias("missing_assessments"),
            exact_mean("score", 2).alias("mean_score"),
            F.round(F.sum(weighted) / F.lit(100).cast("decimal(3,0)"), 2).alias(
                "weighted_progress"
            ),
        )
        .orderBy(*ATTEMPT)
        .limit(n)
    )


def weekly_sample(weekly: DataFrame, n: int = 100) -> DataFrame:
    return _modelled(weekly).orderBy(*ATTEMPT_WEEK).limit(n)


def previous_observed_week(weekly: DataFrame) -> DataFrame:
    """Clicks of the previous observed week; weeks without activity are skipped over."""
    by_week = Window.partitionBy(*ATTEMPT).orderBy("course_week")
    return _modelled(weekly).select(
        *ATTEMPT_WEEK,
        "click_count",
        F.lag("click_count").over(by_week).alias("previous_observed_week_clicks"),
    )


def rolling_two_weeks(weekly: DataFrame) -> DataFrame:
    """Clicks over this and the previous observed week."""
    by_week = Window.partitionBy(*ATTEMPT).orderBy("course_week").rowsBetween(-1, 0)
    return _modelled(weekly).select(
        *ATTEMPT_WEEK, F.sum("click_count").over(by_week).alias("rolling_14_day_clicks")
    )


def first_weeks(rows: DataFrame, n: int = 100) -> DataFrame:
    """The report's rows: the first n in key order."""
    return rows.orderBy(*ATTEMPT_WEEK).limit(n)


def cohort_percentile(weekly: DataFrame) -> DataFrame:
    """Share of the weekly cohort that each attempt is ahead of.

    A cohort can be a third of all rows, so it is never put in one window. Rows are
    counted per click total first; the window runs over the distinct totals, and the
    share is joined back by value (AQE splits a value that is too common).
    """
    cohort = [*PRESENTATION, "course_week"]
    observed = _modelled(weekly).select(*ATTEMPT_WEEK, "click_count")
    values = observed.groupBy(*cohort, "click_count").agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy(*cohort)
    below = group.orderBy("click_count").rowsBetween(Window.unboundedPreceding, -1)
    others = F.sum("rows").over(group) - 1
    share = F.coalesce(F.sum("rows").over(below), F.lit(0)) / F.nullif(others, F.lit(0))
    ranks = values.select(
        *cohort,
        "click_count",
        F.coalesce(share.cast("double"), F.lit(0.0)).alias("cohort_activity_percentile"),
    )
    return observed.join(ranks, [*cohort, "click_count"]).select(
        *ATTEMPT_WEEK, "click_count", "cohort_activity_percentile"
    )


def cohort_percentile_report(weekly: DataFrame, n: int = 100) -> DataFrame:
    return (
        cohort_percentile(weekly)
        .orderBy(
            *PRESENTATION, "course_week", F.desc("cohort_activity_percentile"), "id_student"
        )
        .limit(n)
    )


def longest_gaps(interactions: DataFrame, n: int = 100) -> DataFrame:
    """Longest stretch between two active days of an attempt."""
    days = interactions.select(*ATTEMPT, "activity_day").distinct()
    by_day = Window.partitionBy(*ATTEMPT).orderBy("activity_day")
    gap = F.col("activity_day") - F.lag("activity_day").over(by_day)
    return (
        days.select(*ATTEMPT, gap.alias("gap"))
        .groupBy(*ATTEMPT)
        .agg(F.max("gap").alias("longest_observed_gap_days"))
        .orderBy(F.desc_nulls_last("longest_observed_gap_days"), *ATTEMPT)
        .limit(n)
    )


def withdrawal_alignment(aligned: DataFrame) -> DataFrame:
    """Withdrawing attempts and median clicks by week from the unregistration day."""
    days = F.col("days_relative_to_unregistration")
    return (
        aligned.filter(days.between(-84, 28))
        .groupBy(F.floor(days / F.lit(7)).cast("int").alias("weeks_from_unregistration"))
        .agg(
            F.count_distinct(F.struct(*ATTEMPT)).alias("withdrawing_attempts"),
            F.percentile("click_count", 0.5).alias("median_clicks"),
        )
        .orderBy("weeks_from_unregistration")
    )


def cumulative_progress(progress: DataFrame) -> DataFrame:
    """Running weighted score of each attempt in order of due day."""
    by_due = (
        Window.partitionBy(*ATTEMPT)
        .orderBy("due_day", "id_assessment")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    weighted = (F.coalesce("score", F.lit(0)) * F.col("weight")).cast("decimal(12,4)")
    return progress.select(
        *ATTEMPT,
        "due_day",
        "id_assessment",
        (F.sum(weighted).over(by_due) / F.lit(100).cast("decimal(3,0)")).alias(
            "cumulative_weighted_progress"
        ),
    )


def cumulative_progress_report(progress: DataFrame, n: int = 100) -> DataFrame:
    return (
        cumulative_progress(progress)
        .orderBy(*ATTEMPT, "due_day", "id_assessment")
        .limit(n)
        .drop("id_assessment")
    )


def snapshot_sample(snapshots: DataFrame, n: int = 100) -> DataFrame:
    return snapshots.orderBy(*ATTEMPT_WEEK).limit(n)


def json_path(documents: DataFrame, column: str, path: str, by: list[str]) -> DataFrame:
    """Rows per value found at a path of a JSON column."""
    value = F.get_json_object(column, path)
    return documents.groupBy(*by, value.alias("json_value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
