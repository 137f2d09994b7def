"""Ways to one answer are made once each, compared with their copies, and leave no shuffle files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from courselake.operators import features
from courselake.plans import analysis
from courselake.schemas import ATTEMPT, ATTEMPT_WEEK
from courselake.session import CLEANUP_SETTING, placed_joins


def test_answers_are_made_once_and_compared_with_their_copies(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def once(x):
        made.add(1)
        return x

    rows = "a int, b string"
    first = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], rows).repartition(2)
    other = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], rows)
    found = analysis.compared(
        "q", {"first": first.withColumn("a", once("a")), "other": other, "none": other.limit(0)}
    )
    assert [tuple(r) for r in found.select("variant", "rows", "differing").collect()] == [
        ("first", 4, 0), ("other", 3, 3), ("none", 0, 4)
    ]
    assert made.value == 4
    nothing = analysis.compared("q", {"first": other.limit(0), "other": other.limit(0)}).collect()
    assert [(r["question"], r["rows"], r["differing"]) for r in nothing] == [("q", 0, 0)] * 2


def test_a_join_of_placed_sides_moves_each_row_once(spark):
    data = [("AB"[i % 2] * 3, f"201{3 + i % 3}J", i % 50, i % 14) for i in range(700)]
    spine = spark.createDataFrame(data, list(ATTEMPT_WEEK)).distinct()
    weekly = spine.where("course_week % 3 = 0").withColumn("click_count", F.col("course_week") + 1)
    plain = features.range_join_clicks_binned(spine, weekly).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with placed_joins(spark):
            placed = features.range_join_clicks_binned(spine, weekly, placed=True)
            dealt = [x for x in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x]
            assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert dealt and not any("_bin" in x for x in dealt)
    assert set(ATTEMPT) < set(placed.columns)


def test_shuffle_files_go_with_the_query_that_wrote_them(spark, lake):
    assert lake.attempts.count() and spark.conf.get(CLEANUP_SETTING) == "true"

    def left() -> int:
        home = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(
            name.startswith("shuffle_") for d in home.localDirs() for _, _, names in os.walk(d.getPath()) for name in names
        )

    before = left()
    counted = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert len(counted.collect()) == 7 == len(counted.collect())
    assert left() <= before
