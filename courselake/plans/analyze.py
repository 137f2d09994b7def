"""The analysis run: the data behind the charts and the report's figures, from a built lake."""

from __future__ import annotations

from pyspark.sql import DataFrame

from courselake.operators import marts
from courselake.plans import analysis, gallery
from courselake.plans.pipeline import Layers
from courselake.sources.tables import write_results, write_table


def analysis_tables(lake: Layers, forecast: str | None = None) -> dict[str, DataFrame]:
    """Every analysis table by name, from the layers that ``build_lake`` stored; with the folder of a
    forecast run also the figures that quote it."""
    attempts = lake.read("core", "attempts")
    weekly = lake.read("marts", "weekly_engagement")
    patterns = analysis.assessment_patterns(lake.read("marts", "assessment_progress"))
    medians = analysis.weekly_median(marts.weekly_summary(weekly))
    tables = {
        "outcome_distribution": analysis.outcome_distribution(attempts),
        "weekly_median": medians,
        "consistency": analysis.consistency(attempts, weekly),
        "withdrawal_alignment": gallery.withdrawal_alignment(
            lake.read("marts", "withdrawal_aligned_engagement")
        ),
        "assessment_patterns": patterns,
        "submission_timing": analysis.submission_timing(patterns),
        "extremes": analysis.extremes(patterns),
        "resource_type_usage": lake.read("marts", "resource_type_usage"),
    }
    if forecast is not None:
        read = lake.spark.read.option("header", "true").option("inferSchema", "true")
        folder = f"{forecast.rstrip('/')}/tables"
        tables["report_facts"] = analysis.report_facts(
            attempts, lake.read("quality", "run_results"), read.csv(f"{folder}/threshold_analysis"), medians
        )
        tables["metric_by_week"] = analysis.metric_by_week(read.csv(f"{folder}/grouped_model_metrics"))
    return tables


def run_analysis(lake: Layers, forecast: str | None = None) -> dict[str, DataFrame]:
    """Writes the analysis tables below ``reports/analysis`` of the lake. One row per attempt stays
    parquet; the small tables are text."""
    tables = analysis_tables(lake, forecast)
    folder = f"{lake.root}/reports/analysis"
    write_table(tables["consistency"], f"{folder}/consistency")
    write_results({n: df for n, df in tables.items() if n != "consistency"}, folder)
    return tables
