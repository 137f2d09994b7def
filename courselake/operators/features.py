"""Point-in-time weekly snapshots.

A snapshot is taken at the last day of a course week, so every "known by the
snapshot" condition is a condition on weeks: a day counts at week w exactly when
its own week is at most w, and a due day lies after the snapshot exactly when its
week is greater than w. Assessment facts are therefore reduced to one row per
attempt and week, and both history and look-ahead are windows over at most
``last_week + 2`` rows per attempt. No row is multiplied by the number of weeks
and there is no range join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courselake.functions.columns import exact_ratio, last_day_of, week_of
from courselake.schemas import (
    ASSESSMENT_TARGET,
    ATTEMPT,
    ATTEMPT_WEEK,
    LAST_WEEK,
    NUMERIC_FEATURES,
    PRESENTATION,
    WITHDRAWAL_HORIZON,
    WITHDRAWAL_TARGET,
)

ENGAGEMENT_COLUMNS = [
    "clicks_7d",
    "active_days_7d",
    "distinct_sites_7d",
    "latest_activity_day",
]
MISSING_RULES = ("reference", "as_of")
# The attempt key with its most selective column first: sorts compare that one first.
PLACED_BY = ["id_student", *PRESENTATION]


def snapshot_day(week: Column | str) -> Column:
    """Day of the snapshot of a week. A negative week stops the job."""
    week = F.col(week) if isinstance(week, str) else week
    refused = F.raise_error(F.lit("Snapshots cannot use negative course weeks")).cast("int")
    return F.when(week < 0, refused).otherwise(last_day_of(week))


def attempt_weeks(
    attempts: DataFrame, presentations: DataFrame, last_week: int = LAST_WEEK
) -> DataFrame:
    """One row per attempt and eligible week.

    Weeks run from 0 to the last full week of the presentation, at most
    ``last_week``. The attempt must be registered by the snapshot (an unknown
    registration day never qualifies) and not yet unregistered.
    """
    final_week = F.least(F.lit(last_week), week_of("presentation_length_days"))
    spans = presentations.select(*PRESENTATION, final_week.alias("final_week")).filter(
        "final_week >= 0"
    )
    gone = F.col("unregistration_day") <= F.col("snapshot_day")
    return (
        attempts.select(*ATTEMPT, "registration_day", "unregistration_day")
        .filter(F.col("registration_day").isNotNull())
        .join(spans, PRESENTATION)
        .withColumn("course_week", F.explode(F.sequence(F.lit(0), F.col("final_week"))))
        .withColumn("snapshot_day", last_day_of("course_week"))
        .filter(
            (F.col("registration_day") <= F.col("snapshot_day"))
            & ~F.coalesce(gone, F.lit(False))
        )
        .select(*ATTEMPT_WEEK, "snapshot_day")
    )


def _engagement_rows(weekly: DataFrame, last_week: int) -> DataFrame:
    return weekly.filter(F.col("course_week").between(0, last_week)).select(
        *ATTEMPT_WEEK,
        F.col("click_count").alias("clicks_7d"),
        F.col("active_days").alias("active_days_7d"),
        F.col("distinct_sites").alias("distinct_sites_7d"),
        "latest_activity_day",
    )


def _pack_event(due_day: str, assessment: str, adverse: str) -> Column:
    """An assessment as one long that sorts by (due day, id). Longs aggregate by hash.

    Ids are moved to start at 0, so any 32-bit id fits; days may have 31 bits.
    """
    low = (F.col(assessment).cast("long") + (1 << 31)) * 2 + F.col(adverse)
    return F.shiftleft(F.col(due_day).cast("long"), 33) + low


def _event_due_day(event: Column) -> Column:
    return F.shiftright(event, 33).cast("int")


def _event_assessment(event: Column) -> Column:
    return (F.shiftright(event.bitwiseAND(F.lit((1 << 33) - 1)), 1) - (1 << 31)).cast("int")


def _event_adverse(event: Column) -> Column:
    return event.bitwiseAND(F.lit(1)).cast("int")


def assessment_weeks(
    progress: DataFrame, missing_rule: str = "reference", last_week: int = LAST_WEEK
) -> DataFrame:
    """Assessment facts summed into the week in which each becomes known.

    A submission counts from the week it was handed in. A missing one counts from
    its due week; under ``as_of`` an assessment is missing from its due week until
    the week it is handed in. Weeks before 0 count from week 0. ``next_event`` is
    the earliest assessment due in the week; everything due after ``last_week``
    shares one extra week, which no snapshot can be in.
    """
    if missing_rule not in MISSING_RULES:
        raise ValueError(f"missing_rule must be one of {MISSING_RULES}")
    due_week, hand_in_week = week_of("due_day"), week_of("submitted_day")
    handed_in = progress.filter(F.col("submitted_day").isNotNull())

    def facts(rows: DataFrame, week: Column, **values: Column) -> DataFrame:
        clamped = F.greatest(F.lit(0), F.least(F.lit(last_week + 1), week)).cast("int")
        return rows.select(
            *ATTEMPT, clamped.alias("course_week"), *[v.alias(n) for n, v in values.items()]
        )

    counted = F.col("missing_submission") if missing_rule == "reference" else F.lit(1)
    event = _pack_event("due_day", "id_assessment", "adverse_assessment_event")
    parts = [
        facts(progress, due_week, missing_due=counted, next_event=event),
        facts(
            handed_in,
            hand_in_week,
            submissions=F.lit(1),
            scores=F.when(F.col("score").isNotNull(), 1).otherwise(0),
            score_sum=F.col("score"),
            weighted=(F.col("score") * F.col("weight")).cast("decimal(12,4)"),
        ),
    ]
    if missing_rule == "as_of":
        settled_week = F.greatest(due_week, hand_in_week)
        parts.append(facts(handed_in, settled_week, missing_due=F.lit(-1)))
    return (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        .groupBy(*ATTEMPT_WEEK)
        .agg(
            F.sum("submissions").alias("submissions"),
            F.sum("scores").alias("scores"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("weighted").alias("weighted"),
            F.sum("missing_due").alias("missing_due"),
            F.min("next_event").alias("next_event"),
        )
    )


def timeline(
    spine: DataFrame,
    weekly: DataFrame,
    assessment_facts: DataFrame | None = None,
    last_week: int = LAST_WEEK,
) -> DataFrame:
    """Spine, engagement and assessment facts side by side per attempt and week.

    The inputs are unioned, placed by attempt once and merged per week, so the
    windows that follow need no further shuffle. ``on_spine`` marks eligible
    weeks. Engagement outside them is blanked: it must not enter any window.
    """
    parts = [spine.select(*ATTEMPT_WEEK, F.lit(True).alias("on_spine"))]
    parts.append(_engagement_rows(weekly, last_week))
    values = list(ENGAGEMENT_COLUMNS)
    if assessment_facts is not None:
        parts.append(assessment_facts)
        values += [c for c in assessment_facts.columns if c not in ATTEMPT_WEEK]
    placed = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), parts
    ).repartition(*PLACED_BY)
    merged = placed.groupBy(*PLACED_BY, "course_week").agg(
        F.coalesce(F.max("on_spine"), F.lit(False)).alias("on_spine"),
        *[F.max(v).alias(v) for v in values],
    )

    def counted(name: str) -> Column:
        return F.when(F.col("on_spine"), F.coalesce(name, F.lit(0))).otherwise(0).alias(name)

    return merged.select(
        *ATTEMPT_WEEK,
        "on_spine",
        *[counted(c) for c in ENGAGEMENT_COLUMNS[:3]],
        F.when(F.col("on_spine"), F.col("latest_activity_day")).alias("latest_activity_day"),
        *values[len(ENGAGEMENT_COLUMNS):],
    )


def pad_weeks(spine: DataFrame, weekly: DataFrame, last_week: int = LAST_WEEK) -> DataFrame:
    """The spine with the engagement of each week, 0 where there was none."""
    return (
        timeline(spine, weekly, last_week=last_week)
        .filter("on_spine")
        .select(*ATTEMPT_WEEK, last_day_of("course_week").alias("snapshot_day"), *ENGAGEMENT_COLUMNS)
    )


def _ordered():
    return Window.partitionBy(*PLACED_BY).orderBy("course_week")


def _engagement_window_columns() -> dict[str, Column]:
    fortnight = _ordered().rowsBetween(-1, 0)
    so_far = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    return {
        "clicks_prior_7d": F.lag("clicks_7d", 1, 0).over(_ordered()),
        "clicks_14d": F.sum("clicks_7d").over(fortnight),
        "clicks_to_date": F.sum("clicks_7d").over(so_far),
        "active_days_14d": F.sum("active_days_7d").over(fortnight),
        "distinct_sites_14d": F.sum("distinct_sites_7d").over(fortnight),
        "latest_feature_day": F.max("latest_activity_day").over(so_far),
    }


def _assessment_window_columns() -> dict[str, Column]:
    so_far = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    ahead = _ordered().rowsBetween(1, Window.unboundedFollowing)

    def known(name: str) -> Column:
        return F.coalesce(F.sum(name).over(so_far), F.lit(0))

    mean = exact_ratio(F.sum("score_sum").over(so_far), known("scores"), 3)
    weighted = F.coalesce(F.sum("weighted").over(so_far), F.lit(0)).cast("decimal(24,4)")
    return {
        "submissions_to_date": known("submissions"),
        "mean_score_to_date": mean,
        "missing_due_to_date": known("missing_due"),
        "weighted_score_to_date": F.round(weighted / F.lit(100).cast("decimal(3,0)"), 3),
        "next_event": F.min("next_event").over(ahead),
    }


def _windowed(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    return df.select(*ATTEMPT_WEEK, *keep, *[c.alias(n) for n, c in columns.items()])


def _derived(df: DataFrame) -> DataFrame:
    """Snapshot day, recency and change from the window columns."""
    day = last_day_of("course_week")
    return df.withColumns(
        {
            "snapshot_day": day,
            "days_since_activity": day - F.col("latest_feature_day"),
            "engagement_change": F.col("clicks_7d") - F.col("clicks_prior_7d"),
        }
    )


def engagement_windows(
    spine: DataFrame, weekly: DataFrame, last_week: int = LAST_WEEK
) -> DataFrame:
    """Lag, two-week, cumulative and recency features of each eligible week."""
    rows = timeline(spine, weekly, last_week=last_week)
    keep = ["on_spine", *ENGAGEMENT_COLUMNS]
    windowed = _windowed(rows, _engagement_window_columns(), keep).filter("on_spine")
    return _derived(windowed).drop("on_spine")


def assessment_state(
    spine: DataFrame,
    weekly: DataFrame,
    progress: DataFrame,
    missing_rule: str = "reference",
    last_week: int = LAST_WEEK,
) -> DataFrame:
    """Engagement windows plus assessment history and the next assessment per snapshot."""
    facts = assessment_weeks(progress, missing_rule, last_week)
    rows = timeline(spine, weekly, facts, last_week)
    columns = {**_engagement_window_columns(), **_assessment_window_columns()}
    windowed = _windowed(rows, columns, ["on_spine", *ENGAGEMENT_COLUMNS]).filter("on_spine")
    return _derived(windowed).drop("on_spine")


def next_assessment(state: DataFrame) -> DataFrame:
    """Snapshots that have a next assessment, with its id, due day and outcome."""
    return state.filter(F.col("next_event").isNotNull()).select(
        *[c for c in state.columns if c != "next_event"],
        _event_assessment(F.col("next_event")).alias("next_assessment_id"),
        _event_due_day(F.col("next_event")).alias("next_assessment_due_day"),
        _event_adverse(F.col("next_event")).alias(ASSESSMENT_TARGET),
    )


def withdrawal_label(
    df: DataFrame, attempts: DataFrame, horizon: int = WITHDRAWAL_HORIZON
) -> DataFrame:
    """Adds the attempt's demographics and whether it unregisters within the horizon."""
    leaves = F.col("unregistration_day")
    inside = (leaves > F.col("snapshot_day")) & (leaves <= F.col("snapshot_day") + horizon)
    people = attempts.select(
        *ATTEMPT, "gender", "age_band", "disability", "imd_band", "unregistration_day"
    )
    return (
        df.join(people, PLACED_BY)
        .withColumn(WITHDRAWAL_TARGET, F.when(inside, 1).otherwise(0))
        .drop("unregistration_day")
    )


# The column order of the snapshot mart.
SNAPSHOT_COLUMNS = [
    "code_module",
    "code_presentation",
    "id_student",
    "gender",
    "age_band",
    "disability",
    "imd_band",
    "course_week",
    "snapshot_day",
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
    "latest_feature_day",
    "next_assessment_id",
    "next_assessment_due_day",
    "target_next_assessment_event",
    "target_withdrawal_28d",
]


def model_snapshots(
    attempts: DataFrame,
    presentations: DataFrame,
    weekly: DataFrame,
    progress: DataFrame,
    missing_rule: str = "reference",
    last_week: int = LAST_WEEK,
    horizon: int = WITHDRAWAL_HORIZON,
) -> DataFrame:
    """The snapshot mart: features, demographics and labels per attempt and week."""
    spine = attempt_weeks(attempts, presentations, last_week)
    state = assessment_state(spine, weekly, progress, missing_rule, last_week)
    labelled = withdrawal_label(next_assessment(state), attempts, horizon)
    return labelled.select(*SNAPSHOT_COLUMNS)


def range_join_clicks(spine: DataFrame, weekly: DataFrame, last_week: int = LAST_WEEK) -> DataFrame:
    """Clicks of all weeks up to each spine week, weeks before the spine included.

    Same answer as joining every spine week to its earlier weeks, without the
    join: earlier weeks are added up once and carried by a running sum.
    """
    history = (
        weekly.filter(F.col("course_week") <= last_week)
        .withColumn("course_week", F.greatest(F.lit(0), F.col("course_week")))
        .select(*ATTEMPT_WEEK, "click_count", F.lit(False).alias("on_spine"))
    )
    probes = spine.select(*ATTEMPT_WEEK, F.lit(0).cast("long").alias("click_count"),
                          F.lit(True).alias("on_spine"))
    so_far = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    return (
        history.unionByName(probes)
        .repartition(*PLACED_BY)
        .groupBy(*PLACED_BY, "course_week")
        .agg(F.sum("click_count").alias("click_count"), F.max("on_spine").alias("on_spine"))
        .select(*ATTEMPT_WEEK, "on_spine", F.sum("click_count").over(so_far).alias("clicks_to_week"))
        .filter("on_spine")
        .drop("on_spine")
    )


def range_join_clicks_by_join(spine: DataFrame, weekly: DataFrame) -> DataFrame:
    """The same answer as an equi-join with a residual week condition; kept as a cross-check."""
    history = weekly.select(*ATTEMPT, F.col("course_week").alias("history_week"), "click_count")
    joined = spine.select(*ATTEMPT_WEEK).alias("s").join(
        history.alias("h"),
        reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"h.{k}") for k in ATTEMPT])
        & (F.col("h.history_week") <= F.col("s.course_week")),
        "left",
    )
    return joined.groupBy(*[F.col(f"s.{k}").alias(k) for k in ATTEMPT_WEEK]).agg(
        F.coalesce(F.sum("h.click_count"), F.lit(0)).alias("clicks_to_week")
    )


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str, begin: str, end: str, placed: bool = False
) -> DataFrame:
    """Every pair of a point and an interval of the same keys with begin <= at <= end.

    Points and interval ends are whole numbers. An interval of length n is put into bins of the
    smallest power of two that is no less than n, so it meets two bins at most, however long
    intervals differ; a point looks into one bin for each width that occurs. The join is an
    equi-join on keys, width and bin with an exact residual, so nothing is compared across the
    whole key. Empty intervals and NULL ends match nothing; other columns must differ in name.

    With ``placed``, for keys of few rows each, both sides are dealt by the keys alone before a row
    gets its bins, so it is shuffled once and not once for each width; run it in ``placed_joins``.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*keys) if placed else df

    length = F.col(end) - F.col(begin) + 1
    sized = intervals.where(length > 0).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_level"))
    binned = dealt(sized).withColumn(
        "_bin",
        F.explode(F.sequence(F.floor(F.col(begin) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))),
    )
    widths = sized.agg(F.sort_array(F.collect_set("_level")).alias("levels"))  # at most 64 numbers
    probes = dealt(points).withColumn("_level", F.explode(F.coalesce(widths.scalar(), F.array().cast("array<int>")))).withColumn(
        "_bin", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    )
    met = probes.join(binned, [*keys, "_level", "_bin"])
    return met.where((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_bin")


def range_join_clicks_binned(
    spine: DataFrame, weekly: DataFrame, last_week: int = LAST_WEEK, placed: bool = False
) -> DataFrame:
    """The clicks up to each spine week as an interval join: a week's clicks hold from that week to
    the last one. With ``placed``, for a query run in ``placed_joins``, rows are dealt by attempt."""
    held = weekly.filter(F.col("course_week") <= last_week).select(
        *ATTEMPT, F.col("course_week").alias("since"), F.lit(last_week).alias("until"), "click_count"
    )
    points = spine.select(*ATTEMPT_WEEK)
    known = interval_join(points, held, ATTEMPT, "course_week", "since", "until", placed)
    sums = known.groupBy(*ATTEMPT_WEEK).agg(F.sum("click_count").alias("clicks_to_week"))
    points = points.repartition(*ATTEMPT) if placed else points
    return points.join(sums, ATTEMPT_WEEK, "left").withColumn(
        "clicks_to_week", F.coalesce("clicks_to_week", F.lit(0)).cast("long")
    )


def days_since(
    df: DataFrame, events: DataFrame, cutoff: str, day: str = "activity_day"
) -> DataFrame:
    """Days from the last event at or before each row's cutoff; later events are ignored.

    Events are reduced to distinct days, placed with the rows by attempt and read
    with a running maximum, so an attempt costs its distinct days and not its events.
    """
    known = events.select(*ATTEMPT, F.col(day).alias("at_day")).distinct()
    marks = known.select(*ATTEMPT, "at_day", F.col("at_day").alias("event_day"))
    probes = df.select(*ATTEMPT, F.col(cutoff).alias("at_day"), F.struct(*df.columns).alias("row"))
    until = (
        Window.partitionBy(*PLACED_BY)
        .orderBy("at_day", F.col("row").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marks.unionByName(probes, allowMissingColumns=True)
        .withColumn("last_day", F.max("event_day").over(until))
        .filter(F.col("row").isNotNull())
        .select("row.*", (F.col("at_day") - F.col("last_day")).alias("days_since"))
    )


def temporal_split(
    df: DataFrame, train_until: int = 2013, validation: str = "2014B"
) -> DataFrame:
    """Adds the split of each row, decided by its whole presentation."""
    year = F.substring("code_presentation", 1, 4).cast("int")
    return df.withColumn(
        "split",
        F.when(year <= train_until, "train")
        .when(F.col("code_presentation") == validation, "validation")
        .otherwise("test"),
    )


def require_splits(df: DataFrame) -> None:
    """Raise when one of the three splits has no rows."""
    present = {r.split for r in df.select("split").distinct().collect()}
    absent = sorted({"train", "validation", "test"} - present)
    if absent:
        raise ValueError(f"Temporal split produced an empty partition: {absent}")


# When each feature is known, where it comes from and what keeps later knowledge out.
AVAILABILITY = [
    ("clicks_7d", "end of snapshot week", "weekly engagement", "same week only"),
    ("clicks_prior_7d", "end of prior week", "weekly engagement", "previous week of the attempt"),
    ("clicks_14d", "end of snapshot week", "weekly engagement", "this and the previous week"),
    ("clicks_to_date", "end of snapshot week", "weekly engagement", "running sum ends at the week"),
    ("active_days_14d", "end of snapshot week", "weekly engagement", "this and the previous week"),
    ("distinct_sites_14d", "end of snapshot week", "weekly engagement",
     "this and the previous week, summed"),
    ("days_since_activity", "end of snapshot week", "weekly engagement",
     "running maximum ends at the week"),
    ("engagement_change", "end of snapshot week", "weekly engagement",
     "this week minus the previous one"),
    ("submissions_to_date", "day of submission", "assessment progress",
     "submitted by the snapshot day"),
    ("mean_score_to_date", "day of submission", "assessment progress",
     "submitted by the snapshot day"),
    ("missing_due_to_date", "due day", "assessment progress",
     "due by the snapshot day; the reference rule also knows of later submissions"),
    ("weighted_score_to_date", "day of submission", "assessment progress",
     "submitted by the snapshot day"),
    (ASSESSMENT_TARGET, "after the next due day", "assessment progress", "label, never a feature"),
    (WITHDRAWAL_TARGET, "up to 28 days after the snapshot", "student attempts",
     "label, never a feature"),
]


def availability_registry(spark: SparkSession) -> DataFrame:
    """The availability of every model feature and label; raises if a feature is unlisted."""
    unlisted = sorted(set(NUMERIC_FEATURES) - {row[0] for row in AVAILABILITY})
    if unlisted:
        raise ValueError(f"Features without an availability entry: {unlisted}")
    return spark.createDataFrame(
        AVAILABILITY,
        "feature_name string, available_at string, source string, leakage_control string",
    )


def registry_coverage(snapshots: DataFrame) -> DataFrame:
    """Each registered feature with its non-null and null rows in the snapshots."""
    names = [row[0] for row in AVAILABILITY]
    counts = snapshots.agg(
        *[F.struct(F.count(n), F.count_if(F.col(n).isNull())).alias(n) for n in names]
    ).unpivot([], names, "feature_name", "counts")
    return (
        availability_registry(snapshots.sparkSession)
        .join(counts, "feature_name")
        .select(
            "feature_name",
            "available_at",
            F.col("counts.col1").alias("known_rows"),
            F.col("counts.col2").alias("null_rows"),
        )
    )
