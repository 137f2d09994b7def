"""Analysis tables: the data behind each chart and the figures a report quotes."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.functions.columns import week_of
from courselake.operators.trees import stored
from courselake.schemas import ATTEMPT, FINAL_RESULTS, LAST_WEEK, PRESENTATION
from courselake.session import placed_joins


def outcome_distribution(attempts: DataFrame) -> DataFrame:
    """Attempts per final result in a fixed order; an absent result counts 0."""
    known = F.col("final_result").isin(FINAL_RESULTS)
    counts = attempts.filter(known).groupBy("final_result").agg(F.count(F.lit(1)).alias("n"))
    fixed = attempts.sparkSession.createDataFrame(
        list(enumerate(FINAL_RESULTS)), "position int, final_result string"
    )
    return (
        fixed.join(counts, "final_result", "left")
        .select("position", "final_result", F.coalesce("n", F.lit(0)).alias("attempts"))
        .orderBy("position")
    )


def weekly_median(summary: DataFrame) -> DataFrame:
    """Median over presentations of the weekly median and upper quartile."""
    return (
        summary.groupBy("course_week")
        .agg(
            F.percentile("median_clicks", 0.5).alias("median_clicks"),
            F.percentile("p75_clicks", 0.5).alias("p75_clicks"),
        )
        .orderBy("course_week")
    )


def consistency(attempts: DataFrame, weekly: DataFrame) -> DataFrame:
    """Mean weekly clicks against the number of active weeks per attempt."""
    per_attempt = (
        weekly.filter(F.col("course_week").between(0, LAST_WEEK))
        .groupBy(*ATTEMPT)
        .agg(F.sum("click_count").alias("clicks"), F.count(F.lit(1)).alias("active_weeks"))
    )
    return attempts.select(*ATTEMPT, "final_result").join(per_attempt, ATTEMPT).select(
        "final_result",
        *ATTEMPT,
        (F.col("clicks") / F.col("active_weeks")).alias("mean_weekly_clicks"),
        F.col("active_weeks").cast("int").alias("active_weeks"),
    )


def assessment_patterns(progress: DataFrame) -> DataFrame:
    """Missing rate and median delay per presentation."""
    missing = F.sum("missing_submission").cast("double")
    return (
        progress.groupBy(*PRESENTATION)
        .agg(
            (missing / F.count(F.lit(1))).alias("missing_rate"),
            F.percentile("submission_delay_days", 0.5).alias("median_submission_delay_days"),
            F.count(F.lit(1)).alias("eligible_student_assessments"),
        )
        .orderBy(*PRESENTATION)
    )


def submission_timing(patterns: DataFrame) -> DataFrame:
    """Presentations whose median delay is known."""
    return patterns.filter(F.col("median_submission_delay_days").isNotNull())


def extremes(patterns: DataFrame) -> DataFrame:
    """Presentations at the ends of missing rate and timing; the first key wins a tie."""

    def end(name: str, measure: str, lowest: bool) -> Column:
        value = F.col(measure) if lowest else -F.col(measure)
        row = F.struct(*PRESENTATION, F.col(measure).alias("value"))
        best = F.min_by(row, F.when(value.isNotNull(), F.struct(value, *PRESENTATION)))
        return F.struct(F.lit(name).alias("fact"), best.alias("row"))

    ends = F.array(
        end("lowest missing rate", "missing_rate", True),
        end("highest missing rate", "missing_rate", False),
        end("earliest timing", "median_submission_delay_days", True),
        end("latest timing", "median_submission_delay_days", False),
    )
    return patterns.agg(ends.alias("ends")).select(F.explode("ends").alias("e")).select(
        "e.fact", "e.row.*"
    )


def report_facts(
    attempts: DataFrame, quality: DataFrame, sweep: DataFrame, weekly_medians: DataFrame
) -> DataFrame:
    """The single figures a report quotes, as (fact, value)."""
    totals = attempts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("final_result") == "Withdrawn").alias("withdrawn"),
    ).select(
        F.explode(
            F.create_map(
                F.lit("attempts"), F.col("n").cast("double"),
                F.lit("withdrawal_share"), F.col("withdrawn") / F.col("n"),
            )
        ).alias("fact", "value")
    )
    failed = quality.agg(
        F.count_if((F.col("severity") == "error") & (F.col("status") == "fail"))
        .cast("double")
        .alias("value")
    ).select(F.lit("failed_error_checks").alias("fact"), "value")
    near = F.struct(F.abs(F.col("threshold") - 0.5), "threshold")
    middle = sweep.agg(
        F.min_by(F.struct("records_flagged", "flag_rate", "precision", "recall"), near).alias("m")
    ).select(
        F.explode(
            F.create_map(
                F.lit("flagged_at_half"), F.col("m.records_flagged").cast("double"),
                F.lit("flag_rate_at_half"), F.col("m.flag_rate"),
                F.lit("precision_at_half"), F.col("m.precision"),
                F.lit("recall_at_half"), F.col("m.recall"),
            )
        ).alias("fact", "value")
    )
    weeks = weekly_medians.filter(F.col("course_week").isin(0, 2, LAST_WEEK)).select(
        F.concat(F.lit("median_clicks_week_"), F.col("course_week").cast("string")).alias("fact"),
        F.col("median_clicks").alias("value"),
    )
    return totals.unionByName(failed).unionByName(middle).unionByName(weeks)


def metric_by_week(grouped: DataFrame) -> DataFrame:
    """Metric series over the course weeks."""
    return (
        grouped.filter(F.col("dimension") == "course_week")
        .select(F.col("group").cast("int").alias("course_week"), "pr_auc", "brier")
        .orderBy("course_week")
    )


def weekly_totals_from_fact(interactions: DataFrame) -> DataFrame:
    """Clicks per presentation and week, read from the fact table."""
    return (
        interactions.filter(F.col("activity_day").between(0, 7 * LAST_WEEK + 6))
        .groupBy(*PRESENTATION, week_of("activity_day").alias("course_week"))
        .agg(F.sum("click_count").alias("clicks"))
    )


def weekly_totals_from_mart(weekly: DataFrame) -> DataFrame:
    """The same answer, read from the stored weekly mart."""
    return (
        weekly.filter(F.col("course_week").between(0, LAST_WEEK))
        .groupBy(*PRESENTATION, "course_week")
        .agg(F.sum("click_count").alias("clicks"))
    )


def compared(question: str, variants: dict[str, DataFrame], placed: tuple[str, ...] = ()) -> DataFrame:
    """Ways to one answer, one row each: its rows, and the rows in which it differs from the first.

    Each answer is made once and stored, so the shuffles of one are gone before the next begins; those
    named in ``placed`` run in ``placed_joins``. Rows are compared with their number of copies, in one
    grouped pass over all answers.
    """
    names = list(variants)
    columns = variants[names[0]].columns
    answers = []
    for name, df in variants.items():
        with placed_joins(df.sparkSession) if name in placed else nullcontext():
            answers.append(stored(df.select(*columns), "variant"))
    together = reduce(DataFrame.unionByName, [df.withColumn("_variant", F.lit(i)) for i, df in enumerate(answers)])
    copies = [F.col(f"_copies{i}") for i in range(len(names))]
    counted = together.groupBy(*columns).agg(
        *[F.count_if(F.col("_variant") == i).alias(f"_copies{i}") for i in range(len(names))]
    )
    facts = counted.agg(
        F.array(
            *[
                F.struct(
                    F.lit(question).alias("question"),
                    F.lit(name).alias("variant"),
                    F.coalesce(F.sum(copies[i]), F.lit(0)).alias("rows"),
                    F.coalesce(F.sum(F.abs(copies[0] - copies[i])), F.lit(0)).alias("differing"),
                )
                for i, name in enumerate(names)
            ]
        ).alias("facts")
    )
    return facts.select(F.explode("facts").alias("fact")).select("fact.*")


def timed_pair(
    spark: SparkSession,
    case: str,
    variants: dict[str, Callable[[], DataFrame]],
    runs: int = 3,
) -> DataFrame:
    """Wall-clock medians of ways to one answer; raises when the answers differ."""
    names = list(variants)
    first = variants[names[0]]()
    for other in names[1:]:
        second = variants[other]().select(*first.columns)
        if first.exceptAll(second).limit(1).count() or second.exceptAll(first).limit(1).count():
            raise ValueError(f"{case}: {names[0]} and {other} give different answers")
    rows = []
    for name, build in variants.items():
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        rows.append((case, name, statistics.median(seconds), min(seconds), max(seconds)))
    return spark.createDataFrame(
        rows, "case string, variant string, median_s double, min_s double, max_s double"
    )
