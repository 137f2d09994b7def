"""Timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The layers are built once (timed as ``build_*``), then each query runs once to warm
up and three times for its median. A query's full result is computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from courselake.plans.lake import Lake  # noqa: E402
from courselake.plans.registry import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

BUILDS = {
    "build_core": lambda lake: (
        lake.interactions, lake.submissions, lake.resources, lake.attempts, lake.assessments,
        lake.courses,
    ),
    "build_weekly": lambda lake: lake.weekly,
    "build_progress": lambda lake: lake.progress,
    "build_snapshots": lambda lake: lake.snapshots,
}
HEADLINE = [
    "ana_weekly_from_fact",
    "ana_weekly_from_mart",
    "ana_snapshots_from_store",
    "mart_weekly_engagement",
    "mart_assessment_progress",
    "mart_resource_usage",
    "exp_weekly_summary",
    "feat_range_join",
    "feat_model_snapshots",
    "gal_04",
    "gal_10_all",
    "gal_11",
    "gal_12",
    "gal_14",
    "qc_core",
    "qc_snapshots",
    "con_fk",
    "eva_roc_auc",
    "eva_calibration_bins",
    "eva_thresholds",
    "eva_grouped",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("courselake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    spread: dict[str, list[float]] = {}
    lake = Lake(spark, SF_DIR)
    for name, build in BUILDS.items():
        start = time.perf_counter()
        build(lake)
        seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            consume(QUERIES[name](spark, SF_DIR))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        spread[name] = [round(min(times[1:]), 3), round(max(times[1:]), 3)]
    total = round(sum(seconds[n] for n in HEADLINE), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
