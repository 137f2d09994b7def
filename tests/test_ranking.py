"""Buckets are found by binary search, in shares of a group, and scores are stored before they are ranked."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import functions as F

from courselake.functions import ranking
from courselake.plans import registry


def test_below_counts_like_bisect(spark):
    lists = [[], [0.5], [-math.inf, -1.0, 0.0, 2.5, math.inf], [float(i) for i in range(255)]]
    values = [-math.inf, -1.0, -0.0, 0.0, 0.5, 2.4, 2.5, 7.0, 254.0, 255.0, math.inf, math.nan, None]
    rows = spark.createDataFrame([(s, v) for s in lists for v in values], "s array<double>, v double")
    for s, v, got in rows.select("s", "v", ranking.below(F.col("s"), F.col("v"), 255)).collect():
        want = 0 if v is None else len(s) if math.isnan(v) else bisect_left(s, v)
        assert got == want, (s, v)
    assert rows.select(ranking.below(F.col("s"), F.col("v"), 0)).distinct().collect() == [(0,)]


def test_one_group_looks_for_its_buckets_in_shares(spark):
    counts = spark.range(5000).select(F.lit("all").alias("g"), (F.col("id") * 0.37 % 11).alias("v")).distinct().repartition(3)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        placed = ranking.bucketed(counts, ["g"], "v")
        tasks = placed.groupBy(F.spark_partition_id().alias("task")).count().collect()
        found = placed.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bucket").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tasks) > 8 and sum(t["count"] for t in tasks) == counts.count()
    assert len(found) > 200 and all(a["high"] < b["low"] for a, b in zip(found, found[1:]))


def test_scores_are_stored_before_metrics_rank_them(lake, monkeypatch):
    seen = []
    real = registry.evaluation.evaluate
    monkeypatch.setattr(registry.evaluation, "evaluate", lambda df: seen.append(df) or real(df))
    metrics = registry.model_metrics(lake, "logistic").collect()
    assert {r["split"] for r in metrics} == {"validation", "test"}
    assert seen[0].inputFiles() and all("scores-logistic" in f for f in seen[0].inputFiles())
