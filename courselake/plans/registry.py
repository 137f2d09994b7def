"""The registered queries: one per operator, as (spark, folder) -> DataFrame.

Decimals leave as doubles and fractions are rounded, so that results of different
engines compare; nothing else happens to an operator's result here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.functions.columns import doubles
from courselake.operators import (
    audit,
    constraints,
    core,
    evaluation,
    features,
    marts,
    models,
    newton,
    prep,
    quality,
    staging,
    trees,
)
from courselake.plans import analysis, course, forecast, gallery
from courselake.plans.lake import Lake
from courselake.schemas import (
    ASSESSMENT_TARGET,
    ATTEMPT,
    ATTEMPT_WEEK,
    CATEGORICAL_FEATURES,
    LANDING_FILES,
    LAST_WEEK,
    NUMERIC_FEATURES,
    PRESENTATION,
    SUBMISSION,
    WITHDRAWAL_TARGET,
)
from courselake.sources import files, shelf
from courselake.sources.faults import faulty, malformed_lines, with_bad_cells
from courselake.sources.tables import replace_by, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN_AT = "2020-01-0{} 00:00:00"


def query(name: str):
    def register(build: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, folder: doubles(build(Lake(spark, folder)))
        return build

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Fractions rounded for comparison between engines."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema.fields
        ]
    )


def run_time(n: int):
    return F.lit(RUN_AT.format(n)).cast("timestamp")


def shown(results: DataFrame) -> DataFrame:
    """Quality results with the run time as text."""
    return results.withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd"))


# --- sources and sinks -------------------------------------------------------


def written_landing(lake: Lake) -> str:
    """The seven landing files written from the driver tables; returns their folder."""
    folder = shelf.new_path(lake.spark, "landing")
    for table, df in lake.all_landing().items():
        (
            df.write.option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false")
            .csv(f"{folder}/{LANDING_FILES[table]}")
        )
    return folder


@query("src_land")
def _(lake: Lake) -> DataFrame:
    landed = files.land_folder(lake.spark, written_landing(lake))
    parts = []
    for table, df in landed.items():
        text = F.concat(*[F.col(c).cast("string") for c in df.columns])
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("characters"))
            .select(F.lit(table).alias("table_name"), "rows", "characters")
        )
    return reduce(DataFrame.unionByName, parts)


@query("src_expected_files")
def _(lake: Lake) -> DataFrame:
    folder = written_landing(lake)
    files.require_files(lake.spark, folder, list(LANDING_FILES.values()))
    return audit.landed_against_expected(lake.all_landing(), files.land_folder(lake.spark, folder))


@query("src_rejected_lines")
def _(lake: Lake) -> DataFrame:
    path = shelf.new_path(lake.spark, "malformed")
    lines = malformed_lines(lake.landing("student_assessment"))
    lines.write.option("header", "true").option("sep", "\u0001").csv(path)
    landed, rejected = files.land_or_reject(lake.spark, path, "student_assessment")
    keys = ["id_assessment", "id_student"]
    kept = landed.select(*keys, F.lit("").alias("line"), F.lit("").alias("reason"))
    return kept.unionByName(rejected.select(*keys, "line", "reason"))


@query("src_digest")
def _(lake: Lake) -> DataFrame:
    return files.file_digests(lake.spark, lake.sf_dir)


@query("snk_snapshots")
def _(lake: Lake) -> DataFrame:
    path = shelf.new_path(lake.spark, "export-snapshots")
    order = [*PRESENTATION, "id_student", "course_week"]
    write_table(lake.snapshots, path, order_by=order, fmt="csv", total_order=True)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lake.snapshots.schema)
    return lake.spark.read.schema(types).option("header", "true").csv(path)


@query("snk_quality")
def _(lake: Lake) -> DataFrame:
    path = shelf.new_path(lake.spark, "export-quality")
    results = quality.run_checks(quality.core_checks(), lake.core_tables(), run_time(1))
    write_table(
        quality.latest(results).drop("run_at"),
        path,
        order_by=["severity", "check_name"],
        fmt="csv",
        total_order=True,
    )
    schema = "check_name string, severity string, failing_rows long, status string, detail string"
    return lake.spark.read.schema(schema).option("header", "true").csv(path)


@query("snk_results")
def _(lake: Lake) -> DataFrame:
    folder = shelf.new_path(lake.spark, "results")
    tables = {
        "outcome_distribution": analysis.outcome_distribution(lake.attempts),
        "weekly_engagement_summary": marts.weekly_summary(lake.weekly),
        "assessment_patterns": analysis.assessment_patterns(lake.progress),
        "withdrawal_alignment": gallery.withdrawal_alignment(lake.aligned),
    }
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt="csv")
    return core.row_counts(
        {n: lake.spark.read.option("header", "true").csv(f"{folder}/{n}") for n in tables}
    )


@query("run_metadata")
def _(lake: Lake) -> DataFrame:
    return forecast.run_metadata(lake.split(), lake.split("train"))


# --- audit -------------------------------------------------------------------


@query("aud_rows")
def _(lake: Lake) -> DataFrame:
    return audit.file_profile(lake.all_landing())


@query("aud_missing")
def _(lake: Lake) -> DataFrame:
    return audit.missing_report(lake.all_landing())


@query("aud_scale")
def _(lake: Lake) -> DataFrame:
    return audit.calculated_scale(lake.all_landing())


@query("aud_anomalies")
def _(lake: Lake) -> DataFrame:
    return audit.anomalies(lake.all_landing())


@query("aud_profile")
def _(lake: Lake) -> DataFrame:
    folder = written_landing(lake)
    landed = files.land_folder(lake.spark, folder)
    digests = files.file_digests(lake.spark, folder)
    return audit.narrow_profile(audit.file_profile(landed), digests)


# --- staging -----------------------------------------------------------------

_STAGED = {
    "stg_courses": "courses",
    "stg_assessments": "assessments",
    "stg_resources": "vle",
    "stg_student_info": "student_info",
    "stg_registration": "student_registration",
    "stg_submissions": "student_assessment",
    "stg_interactions": "student_vle",
}
for _name, _table in _STAGED.items():
    query(_name)(lambda lake, table=_table: staging.stage(lake.landing(table), table))


@query("stg_quarantine")
def _(lake: Lake) -> DataFrame:
    typed, rejected = staging.quarantine(
        with_bad_cells(lake.landing("student_assessment")), "student_assessment"
    )
    kept = typed.select(
        F.col("id_assessment").cast("string").alias("id_assessment"),
        F.col("id_student").cast("string").alias("id_student"),
        F.lit("").alias("reason"),
    )
    return kept.unionByName(rejected.select("id_assessment", "id_student", "reason"))


# --- core and constraints ----------------------------------------------------


@query("core_attempts")
def _(lake: Lake) -> DataFrame:
    return core.student_attempts(lake.info, lake.registration)


@query("core_counts")
def _(lake: Lake) -> DataFrame:
    tables = lake.core_tables()
    names = ["presentations", "assessments", "resources", "submissions", "interactions"]
    return core.row_counts({n: tables[n] for n in names} | {"attempts": lake.attempts})


def faulty_core(lake: Lake) -> dict[str, DataFrame]:
    tables = faulty(lake.core_tables())
    attempts = core.student_attempts(tables["student_info"], tables["registration"])
    return {**tables, "attempts": attempts}


@query("con_pk")
def _(lake: Lake) -> DataFrame:
    return constraints.primary_key_report(faulty_core(lake))


@query("con_fk")
def _(lake: Lake) -> DataFrame:
    return constraints.foreign_key_report(faulty_core(lake))


@query("con_not_null")
def _(lake: Lake) -> DataFrame:
    return constraints.not_null_report(faulty_core(lake))


@query("con_check")
def _(lake: Lake) -> DataFrame:
    return constraints.check_report(faulty_core(lake))


@query("con_clean")
def _(lake: Lake) -> DataFrame:
    tables = {**lake.core_tables(), "attempts": lake.attempts}
    return constraints.report([*constraints.key_rules(), *constraints.row_rules()], tables)


# --- quality -----------------------------------------------------------------


def core_results(lake: Lake, run: int = 1) -> DataFrame:
    return quality.run_checks(quality.core_checks(), lake.core_tables(), run_time(run))


def snapshot_results(lake: Lake, run: int = 2) -> DataFrame:
    return quality.run_checks(
        quality.snapshot_checks(), {"snapshots": lake.snapshots}, run_time(run)
    )


@query("qc_core")
def _(lake: Lake) -> DataFrame:
    return shown(core_results(lake))


@query("qc_faults")
def _(lake: Lake) -> DataFrame:
    return shown(
        quality.run_checks(quality.core_checks(), faulty(lake.core_tables()), run_time(1))
    )


@query("qc_snapshots")
def _(lake: Lake) -> DataFrame:
    return shown(snapshot_results(lake))


@query("qc_activity_without_resources")
def _(lake: Lake) -> DataFrame:
    check = next(c for c in quality.core_checks() if c.name == "activity_without_resources")
    return check.offending(faulty(lake.core_tables()))


@query("qc_activity_without_attempts")
def _(lake: Lake) -> DataFrame:
    check = next(c for c in quality.core_checks() if c.name == "activity_without_attempts")
    return check.offending(faulty(lake.core_tables()))


@query("qc_replace")
def _(lake: Lake) -> DataFrame:
    earlier = core_results(lake).unionByName(snapshot_results(lake, 1))
    return shown(quality.replace(earlier, snapshot_results(lake, 2)))


@query("qc_stored")
def _(lake: Lake) -> DataFrame:
    path = shelf.new_path(lake.spark, "check-history")
    replace_by(core_results(lake).unionByName(snapshot_results(lake, 1)), path, "check_name")
    replace_by(snapshot_results(lake, 2), path, "check_name")
    return shown(lake.spark.read.parquet(path).select(*quality.RESULT_COLUMNS))


@query("qc_gate")
def _(lake: Lake) -> DataFrame:
    return quality.gate_summary(core_results(lake).unionByName(snapshot_results(lake)))


@query("qc_latest")
def _(lake: Lake) -> DataFrame:
    faults = quality.run_checks(quality.core_checks(), faulty(lake.core_tables()), run_time(1))
    return shown(
        quality.latest(faults.unionByName(core_results(lake, 2)).unionByName(snapshot_results(lake)))
    )


# --- marts -------------------------------------------------------------------


@query("mart_weekly_engagement")
def _(lake: Lake) -> DataFrame:
    return lake.build_weekly()


@query("mart_assessment_progress")
def _(lake: Lake) -> DataFrame:
    return lake.build_progress().withColumn("is_banked", F.col("is_banked").cast("int"))


@query("mart_withdrawal_aligned")
def _(lake: Lake) -> DataFrame:
    return lake.aligned


@query("mart_course_outcomes")
def _(lake: Lake) -> DataFrame:
    return marts.course_outcomes(lake.attempts)


@query("mart_resource_usage")
def _(lake: Lake) -> DataFrame:
    return marts.resource_usage(lake.interactions, lake.resources)


@query("exp_overview")
def _(lake: Lake) -> DataFrame:
    return marts.overview(lake.courses, lake.attempts, lake.assessments, lake.interactions)


@query("exp_weekly_summary")
def _(lake: Lake) -> DataFrame:
    return marts.weekly_summary(lake.weekly)


@query("exp_assessment_summary")
def _(lake: Lake) -> DataFrame:
    return marts.assessment_summary(lake.progress)


@query("grain_checks")
def _(lake: Lake) -> DataFrame:
    return marts.grain_report(
        {
            "weekly_engagement": (lake.weekly, ATTEMPT_WEEK),
            "assessment_progress": (lake.progress, SUBMISSION),
            "model_snapshots": (lake.snapshots, ATTEMPT_WEEK),
        }
    )


# --- features ----------------------------------------------------------------


def windows(lake: Lake, *columns: str) -> DataFrame:
    return features.engagement_windows(lake.spine, lake.weekly).select(*ATTEMPT_WEEK, *columns)


def state(lake: Lake, missing_rule: str = "reference") -> DataFrame:
    return features.assessment_state(lake.spine, lake.weekly, lake.progress, missing_rule)


@query("feat_spine")
def _(lake: Lake) -> DataFrame:
    return lake.spine


@query("feat_padded")
def _(lake: Lake) -> DataFrame:
    return features.pad_weeks(lake.spine, lake.weekly)


@query("feat_lag")
def _(lake: Lake) -> DataFrame:
    return windows(lake, "clicks_7d", "clicks_prior_7d")


@query("feat_rolling")
def _(lake: Lake) -> DataFrame:
    return windows(lake, "clicks_14d", "active_days_14d", "distinct_sites_14d")


@query("feat_cumulative")
def _(lake: Lake) -> DataFrame:
    return windows(lake, "clicks_to_date")


@query("feat_recency")
def _(lake: Lake) -> DataFrame:
    return windows(lake, "latest_feature_day", "days_since_activity")


@query("feat_change")
def _(lake: Lake) -> DataFrame:
    return windows(lake, "engagement_change")


@query("feat_history")
def _(lake: Lake) -> DataFrame:
    return state(lake).select(
        *ATTEMPT_WEEK,
        "submissions_to_date",
        "mean_score_to_date",
        "missing_due_to_date",
        "weighted_score_to_date",
    )


@query("feat_history_as_of")
def _(lake: Lake) -> DataFrame:
    return state(lake, "as_of").select(*ATTEMPT_WEEK, "missing_due_to_date")


@query("feat_next_assessment")
def _(lake: Lake) -> DataFrame:
    return features.next_assessment(state(lake)).select(
        *ATTEMPT_WEEK, "next_assessment_id", "next_assessment_due_day", ASSESSMENT_TARGET
    )


@query("feat_withdrawal_label")
def _(lake: Lake) -> DataFrame:
    return features.withdrawal_label(lake.spine, lake.attempts).select(
        *ATTEMPT_WEEK, WITHDRAWAL_TARGET
    )


@query("feat_model_snapshots")
def _(lake: Lake) -> DataFrame:
    return lake.build_snapshots()


@query("feat_registry")
def _(lake: Lake) -> DataFrame:
    return features.registry_coverage(lake.snapshots)


@query("feat_range_join")
def _(lake: Lake) -> DataFrame:
    return features.range_join_clicks(lake.spine, lake.weekly)


@query("feat_range_join_binned")
def _(lake: Lake) -> DataFrame:
    return features.range_join_clicks_binned(lake.spine, lake.weekly)


@query("feat_snapshot_day")
def _(lake: Lake) -> DataFrame:
    known = lake.weekly.filter(F.col("course_week") >= 0)
    return known.select(*ATTEMPT_WEEK, features.snapshot_day("course_week").alias("snapshot_day"))


@query("feat_days_since")
def _(lake: Lake) -> DataFrame:
    return features.days_since(lake.spine, lake.interactions, "snapshot_day")


@query("feat_split")
def _(lake: Lake) -> DataFrame:
    return (
        features.temporal_split(lake.snapshots)
        .groupBy("split", "code_presentation")
        .agg(F.count(F.lit(1)).alias("snapshots"))
    )


@query("feat_leakage_guard")
def _(lake: Lake) -> DataFrame:
    quality.assert_no_future(lake.snapshots)
    return quality.leaking(lake.snapshots).agg(F.count(F.lit(1)).alias("leaking_snapshots"))


# --- gallery -----------------------------------------------------------------


@query("gal_01")
def _(lake: Lake) -> DataFrame:
    return gallery.source_rows(lake.all_landing())


@query("gal_02")
def _(lake: Lake) -> DataFrame:
    return gallery.attempts_and_students(lake.attempts)


@query("gal_03")
def _(lake: Lake) -> DataFrame:
    return gallery.outcomes_by_presentation(marts.course_outcomes(lake.attempts))


@query("gal_04")
def _(lake: Lake) -> DataFrame:
    return gallery.busiest_attempts(lake.attempts, lake.weekly)


@query("gal_05")
def _(lake: Lake) -> DataFrame:
    return gallery.quality_results(core_results(lake).unionByName(snapshot_results(lake)))


@query("gal_06")
def _(lake: Lake) -> DataFrame:
    return gallery.attempt_progress(lake.progress)


@query("gal_07")
def _(lake: Lake) -> DataFrame:
    return gallery.weekly_sample(lake.weekly)


@query("gal_08")
def _(lake: Lake) -> DataFrame:
    return gallery.first_weeks(gallery.previous_observed_week(lake.weekly))


@query("gal_08_all")
def _(lake: Lake) -> DataFrame:
    return gallery.previous_observed_week(lake.weekly)


@query("gal_09")
def _(lake: Lake) -> DataFrame:
    return gallery.first_weeks(gallery.rolling_two_weeks(lake.weekly))


@query("gal_09_all")
def _(lake: Lake) -> DataFrame:
    return gallery.rolling_two_weeks(lake.weekly)


@query("gal_10")
def _(lake: Lake) -> DataFrame:
    return rounded(gallery.cohort_percentile_report(lake.weekly))


@query("gal_10_all")
def _(lake: Lake) -> DataFrame:
    return rounded(gallery.cohort_percentile(lake.weekly))


@query("gal_11")
def _(lake: Lake) -> DataFrame:
    return gallery.longest_gaps(lake.interactions)


@query("gal_12")
def _(lake: Lake) -> DataFrame:
    return gallery.withdrawal_alignment(lake.aligned)


@query("gal_13")
def _(lake: Lake) -> DataFrame:
    return gallery.cumulative_progress_report(lake.progress)


@query("gal_13_all")
def _(lake: Lake) -> DataFrame:
    return gallery.cumulative_progress(lake.progress)


@query("gal_14")
def _(lake: Lake) -> DataFrame:
    return gallery.snapshot_sample(lake.snapshots)


@query("gal_15_json")
def _(lake: Lake) -> DataFrame:
    events = lake.spark.read.parquet(f"{lake.sf_dir}/events.parquet")
    return gallery.json_path(events, "props", "$.k", ["event_type"])


# --- course ------------------------------------------------------------------


@query("crs_courses")
def _(lake: Lake) -> DataFrame:
    return course.first_courses(lake.landing("courses"))


@query("crs_modules")
def _(lake: Lake) -> DataFrame:
    return course.modules_and_presentations(lake.landing("courses"))


@query("crs_early_registration")
def _(lake: Lake) -> DataFrame:
    return course.early_registration(lake.attempts)


@query("crs_first_week")
def _(lake: Lake) -> DataFrame:
    return course.first_week_activity(lake.interactions)


@query("crs_registration_timing")
def _(lake: Lake) -> DataFrame:
    return course.registration_timing(lake.attempts)


@query("crs_result_share")
def _(lake: Lake) -> DataFrame:
    return course.result_share(lake.attempts)


@query("crs_score_summary")
def _(lake: Lake) -> DataFrame:
    return course.score_summary(lake.submissions)


@query("crs_large_presentations")
def _(lake: Lake) -> DataFrame:
    return course.large_presentations(lake.attempts, at_least=280)


@query("crs_attempts_per_student")
def _(lake: Lake) -> DataFrame:
    return course.attempts_per_student(lake.attempts)


@query("crs_registration_range")
def _(lake: Lake) -> DataFrame:
    return course.registration_range(lake.registration)


@query("crs_assessment_types")
def _(lake: Lake) -> DataFrame:
    return course.assessment_types(lake.assessments)


@query("crs_activity_profile")
def _(lake: Lake) -> DataFrame:
    return course.activity_profile(lake.interactions)


@query("crs_fail_withdrawn")
def _(lake: Lake) -> DataFrame:
    return course.failed_or_withdrawn(lake.attempts)


@query("crs_module_results")
def _(lake: Lake) -> DataFrame:
    return course.module_results(lake.attempts)


@query("crs_missing_share")
def _(lake: Lake) -> DataFrame:
    return course.missing_share(lake.attempts)


@query("crs_repeat_students")
def _(lake: Lake) -> DataFrame:
    return course.repeat_students(lake.attempts)


@query("crs_duplicate_keys")
def _(lake: Lake) -> DataFrame:
    return course.duplicate_keys(faulty(lake.core_tables())["student_info"])


# --- analysis ----------------------------------------------------------------


@query("ana_outcomes")
def _(lake: Lake) -> DataFrame:
    return analysis.outcome_distribution(lake.attempts)


@query("ana_weekly_median")
def _(lake: Lake) -> DataFrame:
    return rounded(analysis.weekly_median(marts.weekly_summary(lake.weekly)))


@query("ana_consistency")
def _(lake: Lake) -> DataFrame:
    return rounded(analysis.consistency(lake.attempts, lake.weekly))


@query("ana_assessment_patterns")
def _(lake: Lake) -> DataFrame:
    return rounded(analysis.submission_timing(analysis.assessment_patterns(lake.progress)))


@query("ana_extremes")
def _(lake: Lake) -> DataFrame:
    return rounded(analysis.extremes(analysis.assessment_patterns(lake.progress)))


@query("ana_facts")
def _(lake: Lake) -> DataFrame:
    sweep = evaluation.threshold_sweep(evaluation.predictions(lake.scored))
    medians = analysis.weekly_median(marts.weekly_summary(lake.weekly))
    return rounded(analysis.report_facts(lake.attempts, core_results(lake), sweep, medians))


@query("ana_metric_by_week")
def _(lake: Lake) -> DataFrame:
    return rounded(analysis.metric_by_week(evaluation.grouped_metrics(lake.scored)))


@query("ana_weekly_from_fact")
def _(lake: Lake) -> DataFrame:
    return analysis.weekly_totals_from_fact(lake.interactions)


@query("ana_weekly_from_mart")
def _(lake: Lake) -> DataFrame:
    return analysis.weekly_totals_from_mart(lake.weekly)


@query("ana_pairs")
def _(lake: Lake) -> DataFrame:
    weekly = analysis.compared(
        "weekly totals",
        {"fact": analysis.weekly_totals_from_fact(lake.interactions), "mart": analysis.weekly_totals_from_mart(lake.weekly)},
    )
    known = analysis.compared(
        "clicks to week",
        {
            "running sum": features.range_join_clicks(lake.spine, lake.weekly),
            "binned intervals": features.range_join_clicks_binned(lake.spine, lake.weekly, placed=True),
            "equi-join": features.range_join_clicks_by_join(lake.spine, lake.weekly),
        },
        placed=("binned intervals",),
    )
    return weekly.unionByName(known)


@query("ana_snapshots_from_store")
def _(lake: Lake) -> DataFrame:
    return lake.snapshots.select(*ATTEMPT_WEEK, "clicks_to_date")


# --- preprocessing and models ------------------------------------------------


@query("ml_impute_numeric")
def _(lake: Lake) -> DataFrame:
    fitted = prep.fit_imputer(lake.split("train"), NUMERIC_FEATURES)
    filled = prep.apply_imputer(lake.split("test"), fitted)
    return rounded(filled.select(*ATTEMPT_WEEK, "days_since_activity", "mean_score_to_date"))


@query("ml_scale")
def _(lake: Lake) -> DataFrame:
    columns = ["clicks_7d", "clicks_to_date", "engagement_change"]
    fitted = prep.fit_scaler(lake.split("train"), columns)
    return rounded(
        prep.apply_scaler(lake.split("test"), fitted).select(*ATTEMPT_WEEK, *columns), 5
    )


@query("ml_impute_mode")
def _(lake: Lake) -> DataFrame:
    columns = ["imd_band", *CATEGORICAL_FEATURES]
    fitted = prep.fit_mode(lake.split("train"), columns)
    return prep.apply_imputer(lake.split("test"), fitted).select(*ATTEMPT_WEEK, "imd_band")


@query("ml_one_hot")
def _(lake: Lake) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    encoder = Pipeline(stages=prep.one_hot(["code_module"])).fit(lake.split("train"))
    unknown = F.when(F.col("id_student") % 10 != 0, F.col("code_module")).otherwise("ZZZ")
    coded = encoder.transform(lake.split("test").withColumns({"own": F.col("code_module"), "code_module": unknown}))
    return coded.withColumn("code_module", F.col("own")).select(
        *ATTEMPT_WEEK,
        F.array_join(
            F.transform(vector_to_array("code_module_hot"), lambda x: x.cast("int").cast("string")),
            "",
        ).alias("hot"),
    )


@query("ml_class_weights")
def _(lake: Lake) -> DataFrame:
    return rounded(prep.class_weights(lake.split("train"), ASSESSMENT_TARGET))


@query("ml_prevalence")
def _(lake: Lake) -> DataFrame:
    scored = models.prevalence(lake.split("train"), lake.split("test"), ASSESSMENT_TARGET)
    return rounded(scored.select(*ATTEMPT_WEEK, "probability"))


@query("ml_rule")
def _(lake: Lake) -> DataFrame:
    scored = models.rule_baseline(lake.split("train"), lake.split("test"))
    return scored.select(*ATTEMPT_WEEK, "probability")


def fitted_model(lake: Lake, name: str):
    """A pipeline fitted on the train split, saved and read back once per application.

    All fits share one preparation, which is saved and read back too.
    """
    train = lake.split("train")

    def stages() -> list:
        return lake.shelf.model("preparation", lambda: PipelineModel(models.preparation(train))).stages

    fits = {
        "logistic": lambda: models.fit_logistic(train, stages=stages()),
        "tree": lambda: models.fit_tree(train, stages=stages()),
        "gbt": lambda: models.fit_gbt(train, stages=stages()),
        "withdrawal": lambda: models.fit_logistic(train, WITHDRAWAL_TARGET, stages=stages()),
    }
    return lake.shelf.model(name, fits[name])


def model_metrics(lake: Lake, name: str, label: str = ASSESSMENT_TARGET) -> DataFrame:
    later = lake.split().filter(F.col("split") != "train")
    scored = forecast.labelled(models.score(fitted_model(lake, name), later), name, label)
    # an evaluation reads the scores more than once
    scored = trees.stored(scored.select("model", "split", "y", "probability"), f"scores-{name}")
    return rounded(evaluation.evaluate(scored))


@query("ml_logistic")
def _(lake: Lake) -> DataFrame:
    return model_metrics(lake, "logistic")


@query("ml_tree")
def _(lake: Lake) -> DataFrame:
    return model_metrics(lake, "tree")


@query("ml_gbt")
def _(lake: Lake) -> DataFrame:
    return model_metrics(lake, "gbt")


@query("ml_tree_splits")
def _(lake: Lake) -> DataFrame:
    fitted = trees.fit_exact_tree(
        lake.split("train"), ASSESSMENT_TARGET, NUMERIC_FEATURES, CATEGORICAL_FEATURES, depth=2
    )
    return rounded(fitted.table(lake.spark))


@query("ml_boosted_leaves")
def _(lake: Lake) -> DataFrame:
    fitted = trees.fit_boosted(
        lake.split("train"), ASSESSMENT_TARGET, NUMERIC_FEATURES, CATEGORICAL_FEATURES, depth=2, rounds=2
    )
    sums = [F.round(c, 5).alias(c) for c in ("gradient", "hessian")]
    return fitted.leaves(lake.spark).select("tree", "leaf", "rows", *sums, F.round("value", 6).alias("value"))


NEWTON_INPUTS = ["clicks_7d", "missing_due_to_date"]


@query("ml_newton")
def _(lake: Lake) -> DataFrame:
    train = lake.split("train")
    scales = prep.fit_scaler(train, NEWTON_INPUTS)
    weights = prep.class_weights(train, ASSESSMENT_TARGET)
    rows = prep.weigh(prep.apply_scaler(train, scales), ASSESSMENT_TARGET, weights)
    rows = trees.stored(rows.select(*NEWTON_INPUTS, F.col(ASSESSMENT_TARGET).cast("double").alias("y"), "weight"), "newton")
    inputs = [F.col(c) for c in NEWTON_INPUTS]
    fitted = newton.fit_newton(rows, NEWTON_INPUTS, inputs, F.col("y"), F.col("weight"))
    mean = F.sum(F.col("weight") / (1.0 + F.exp(-fitted.margin(inputs)))) / F.sum("weight")
    return fitted.table(lake.spark).select(
        "term", F.round("coefficient", 5).alias("coefficient"), F.round("odds_ratio", 5).alias("odds_ratio"),
        (F.abs("gradient") < 1e-4).alias("optimal"), F.round(rows.agg(mean).scalar(), 5).alias("mean_probability"),
    )


@query("ml_calibrated_mean")
def _(lake: Lake) -> DataFrame:
    later = lake.split().filter(F.col("split") == "validation")
    margins = models.score(fitted_model(lake, "logistic"), later).withColumn("y", F.col(ASSESSMENT_TARGET))
    calibrated = models.apply_sigmoid(models.fit_sigmoid(margins), margins)
    return calibrated.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 4).alias("mean_probability"))


@query("ml_calibrated")
def _(lake: Lake) -> DataFrame:
    later = lake.split().filter(F.col("split") != "train")
    margins = models.score(fitted_model(lake, "logistic"), later).withColumn(
        "y", F.col(ASSESSMENT_TARGET)
    )
    sigmoid = models.fit_sigmoid(margins.filter("split = 'validation'"))
    calibrated = models.apply_sigmoid(sigmoid, margins.filter("split = 'test'"))
    return rounded(
        evaluation.evaluate(forecast.labelled(calibrated, "calibrated", ASSESSMENT_TARGET))
    )


@query("ml_withdrawal")
def _(lake: Lake) -> DataFrame:
    later = lake.split().filter(F.col("split") != "train")
    base = models.prevalence(lake.split("train"), later, WITHDRAWAL_TARGET)
    base = forecast.labelled(base, "withdrawal_prevalence", WITHDRAWAL_TARGET)
    return model_metrics(lake, "withdrawal", WITHDRAWAL_TARGET).unionByName(
        rounded(evaluation.evaluate(base))
    )


@query("ml_coefficients")
def _(lake: Lake) -> DataFrame:
    return rounded(models.coefficients(fitted_model(lake, "logistic")))


@query("ml_permutation")
def _(lake: Lake) -> DataFrame:
    return rounded(models.permutation_importance(fitted_model(lake, "gbt"), lake.split("test")))


@query("ml_permuted_rows")
def _(lake: Lake) -> DataFrame:
    test = lake.split("test").select(*ATTEMPT_WEEK)
    numbered = models.numbered_rows(test)
    drawn = models.with_donors(numbered, test.count(), ["clicks_to_date", "clicks_7d"], 2)
    return drawn.select(
        *ATTEMPT_WEEK, F.col("_row").alias("row"), "feature", "repeat", F.col("_donor").alias("donor")
    )


@query("ml_reloaded")
def _(lake: Lake) -> DataFrame:
    test = lake.split("test")
    model = fitted_model(lake, "logistic")
    path = shelf.new_path(lake.spark, "contract-model")
    models.save_model(model, lake.split("train"), path)
    loaded = models.load_model(lake.spark, path)
    changed = test.drop("clicks_7d").withColumn("clicks_to_date", F.col("clicks_to_date").cast("string"))
    faults = "; ".join(sorted(models.contract_faults(changed, loaded[1])))
    before = models.score(model, test).select(*ATTEMPT_WEEK, F.col("probability").alias("before"))
    after = models.score_by_contract(loaded, test).select(*ATTEMPT_WEEK, "probability")
    return before.join(after, ATTEMPT_WEEK).groupBy(*PRESENTATION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("before") == F.col("probability")).alias("same"),
        F.lit(faults).alias("faults"),
    )


# --- evaluation --------------------------------------------------------------


@query("eva_confusion")
def _(lake: Lake) -> DataFrame:
    return evaluation.confusion(lake.scored, by=("model", "split"))


@query("eva_threshold_metrics")
def _(lake: Lake) -> DataFrame:
    by = ("model", "split")
    return rounded(evaluation.threshold_metrics(evaluation.confusion(lake.scored, by=by), by))


def metric(lake: Lake, name: str) -> DataFrame:
    return rounded(evaluation.evaluate(lake.scored).select("model", "split", "n", name))


@query("eva_roc_auc")
def _(lake: Lake) -> DataFrame:
    return metric(lake, "roc_auc")


@query("eva_average_precision")
def _(lake: Lake) -> DataFrame:
    return metric(lake, "pr_auc")


@query("eva_brier")
def _(lake: Lake) -> DataFrame:
    return metric(lake, "brier")


@query("eva_predictions")
def _(lake: Lake) -> DataFrame:
    return evaluation.predictions(lake.scored.filter("split = 'test'"))


@query("eva_calibration_bins")
def _(lake: Lake) -> DataFrame:
    return rounded(evaluation.calibration_bins(lake.scored.filter("split = 'test'")))


@query("eva_thresholds")
def _(lake: Lake) -> DataFrame:
    test = evaluation.predictions(lake.scored.filter("split = 'test'"))
    return rounded(evaluation.threshold_sweep(test))


@query("eva_grouped")
def _(lake: Lake) -> DataFrame:
    return rounded(evaluation.grouped_metrics(lake.scored.filter("split = 'test'")))
