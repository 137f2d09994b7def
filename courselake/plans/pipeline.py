"""The batch run from landing files to snapshots, one stored layer after the other.

Each layer is a folder of parquet tables. Quality runs on the typed rows before the
core constraints are enforced, so a violation is reported and not only raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.operators import audit, constraints, core, features, marts, quality, staging
from courselake.operators.checking import Watched
from courselake.schemas import (
    ATTEMPT,
    ATTEMPT_WEEK,
    LANDING_FILES,
    PRESENTATION,
    SUBMISSION,
)
from courselake.session import sized_shuffles
from courselake.sources.files import file_digests, land_folder, require_digests, require_files
from courselake.sources.shelf import folder_size
from courselake.sources.tables import replace_by, write_results, write_table

STAGED = {
    "courses": "presentations",
    "assessments": "assessments",
    "vle": "resources",
    "student_info": "student_info",
    "student_registration": "registration",
    "student_assessment": "submissions",
    "student_vle": "interactions",
}


class Layers:
    """Reads and writes ``<root>/<layer>/<table>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def store(self, df: DataFrame, layer: str, table: str, **layout) -> DataFrame:
        write_table(df, self.path(layer, table), **layout)
        return self.read(layer, table)

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, table))


def ingest(spark: SparkSession, source: str, lake: Layers) -> dict[str, DataFrame]:
    """Landing files into the raw layer. Text stays as it was."""
    require_files(spark, source, list(LANDING_FILES.values()))
    return {t: lake.store(df, "raw", t) for t, df in land_folder(spark, source).items()}


def profile(
    spark: SparkSession, source: str, raw: dict[str, DataFrame], lake: Layers, expected_digests=None
) -> None:
    """Audit tables of the raw layer; stops when a file's digest isn't the expected one."""
    files = audit.file_profile(raw)
    digests = file_digests(spark, source)
    if expected_digests is not None:
        digests = lake.store(digests, "quality", "file_digests")
        require_digests(digests, expected_digests)
    tables = {
        "file_profile": audit.narrow_profile(files, digests),
        "missing_cells": audit.missing_report(raw),
        "calculated_scale": audit.calculated_scale(raw),
        "anomalies": audit.anomalies(raw),
    }
    write_results(tables, f"{lake.root}/reports/audit")


def build_core(raw: dict[str, DataFrame], lake: Layers, expected_rows=None) -> DataFrame:
    """Typed rows, quality on them, then the constrained core tables. Returns the results."""
    staged = {STAGED[t]: staging.stage(df, t) for t, df in raw.items()}
    checks = quality.core_checks(expected_rows)
    results = lake.store(quality.run_checks(checks, staged), "quality", "core_results")
    replace_by(results, lake.path("quality", "run_results"), "check_name")
    quality.gate(results)

    # Ranging over attempt and day clusters an attempt's rows, and still splits an
    # attempt that holds a large share of them.
    activity_order = [*ATTEMPT, "activity_day"]
    layout = {"attempts": ATTEMPT, "submissions": SUBMISSION, "interactions": activity_order}
    frames = {
        "presentations": staged["presentations"],
        "assessments": staged["assessments"],
        "resources": staged["resources"],
        "attempts": core.student_attempts(staged["student_info"], staged["registration"]),
        "submissions": staged["submissions"],
        "interactions": staged["interactions"].repartitionByRange(*activity_order),
    }
    # row constraints are counted by the write itself, key constraints on what was written
    rules = constraints.row_rules()
    tables, counted = {}, []
    for name, df in frames.items():
        watched = Watched(df, name, rules)
        tables[name] = lake.store(watched.frame, "core", name, order_by=layout.get(name))
        counted += watched.violations()
    constraints.enforce([constraints.report(constraints.key_rules(), tables)], counted)
    return results


def build_marts(lake: Layers, missing_rule: str = "reference") -> DataFrame:
    """Marts, snapshots and their guards from the core layer. Returns the snapshots."""
    tables = {
        t: lake.read("core", t)
        for t in ["presentations", "assessments", "resources", "attempts", "submissions",
                  "interactions"]
    }
    attempts = tables["attempts"]
    weekly = lake.store(
        marts.weekly_engagement(tables["interactions"]),
        "marts",
        "weekly_engagement",
        partition_by=["code_presentation"],
        order_by=["code_module", "id_student", "course_week"],
    )
    progress = lake.store(
        marts.assessment_progress(attempts, tables["assessments"], tables["submissions"]),
        "marts",
        "assessment_progress",
        partition_by=["code_presentation"],
        order_by=["code_module", "id_student", "due_day"],
    )
    lake.store(
        marts.resource_usage(tables["interactions"], tables["resources"]), "marts", "resource_type_usage"
    )
    lake.store(
        marts.withdrawal_aligned(attempts, weekly), "marts", "withdrawal_aligned_engagement"
    )
    snapshots = lake.store(
        features.model_snapshots(
            attempts, tables["presentations"], weekly, progress, missing_rule=missing_rule
        ),
        "marts",
        "model_snapshots",
        partition_by=["code_presentation"],
        order_by=["code_module", "id_student", "course_week"],
    )
    marts.assert_grain(weekly, ATTEMPT_WEEK)
    marts.assert_grain(progress, SUBMISSION)
    marts.assert_grain(snapshots, ATTEMPT_WEEK)
    quality.assert_no_future(snapshots)
    return snapshots


def build_lake(
    spark: SparkSession,
    source: str,
    root: str,
    expected_rows: dict[str, int] | None = None,
    missing_rule: str = "reference",
    expected_digests: DataFrame | None = None,
) -> Layers:
    """The whole batch run; any failed gate or guard stops it.

    ``expected_digests`` holds (part, sha256) per landing file.
    """
    with sized_shuffles(spark, folder_size(spark, source).bytes):
        return _build(spark, source, root, expected_rows, missing_rule, expected_digests)


def _build(spark, source, root, expected_rows, missing_rule, expected_digests) -> Layers:
    lake = Layers(spark, root)
    raw = ingest(spark, source, lake)
    profile(spark, source, raw, lake, expected_digests)
    build_core(raw, lake, expected_rows)
    snapshots = build_marts(lake, missing_rule)
    snapshot_results = quality.run_checks(quality.snapshot_checks(), {"snapshots": snapshots})
    replace_by(snapshot_results, lake.path("quality", "run_results"), "check_name")
    results = lake.read("quality", "run_results").select(*quality.RESULT_COLUMNS)
    quality.gate(results)

    weekly = lake.read("marts", "weekly_engagement")
    progress = lake.read("marts", "assessment_progress")
    attempts = lake.read("core", "attempts")
    write_results(
        {
            "portfolio_overview": marts.overview(
                lake.read("core", "presentations"),
                attempts,
                lake.read("core", "assessments"),
                lake.read("core", "interactions"),
            ),
            "course_outcome_summary": marts.course_outcomes(attempts),
            "weekly_engagement_summary": marts.weekly_summary(weekly),
            "assessment_summary": marts.assessment_summary(progress),
            "sql_quality_results": quality.latest(results),
        },
        f"{lake.root}/reports/tables",
    )
    write_table(
        snapshots,
        f"{lake.root}/export/model_snapshots",
        order_by=[F.col(c) for c in [*PRESENTATION, "id_student", "course_week"]],
        fmt="csv",
        total_order=True,
    )
    return lake
