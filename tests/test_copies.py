"""Shuffled copies are dealt over tasks by their number, and scored once."""

from __future__ import annotations

from pyspark.sql import functions as F

from courselake.operators import models
from courselake.schemas import ATTEMPT_WEEK, CATEGORICAL_FEATURES, NUMERIC_FEATURES


def _rows(spark, n):
    names = {"code_module": "AAA", "code_presentation": "2014J", "presentation_term": "J"}
    key = [F.lit(names[c]).alias(c) if c in names else F.col("id").cast("int").alias(c) for c in ATTEMPT_WEEK]
    term = [F.lit(names[c]).alias(c) for c in CATEGORICAL_FEATURES if c not in ATTEMPT_WEEK]
    numbers = [(F.col("id") % 7).cast("double").alias(c) for c in NUMERIC_FEATURES]
    return spark.range(n).select(*key, *term, *numbers, (F.col("id") % 2).cast("int").alias("event"))


def test_copies_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "COPIES_PER_TASK", 200, raising=False)
    copies = models.permuted_copies(_rows(spark, 100), 2)
    tasks = copies.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 100 * 2 * len(models.FEATURES)
    assert len(tasks) > 8


def test_scores_are_stored_before_they_are_evaluated(spark, monkeypatch):
    seen = []
    real = models.evaluate
    monkeypatch.setattr(models, "evaluate", lambda df, by: seen.append(df) or real(df, by=by))
    monkeypatch.setattr(
        models, "score", lambda model, df: df.withColumn("probability", F.col("clicks_7d") / F.lit(7.0))
    )
    loss = models.permutation_importance(None, _rows(spark, 100), "event", 2)
    assert {r["feature"] for r in loss.collect()} == set(models.FEATURES)
    assert all("permuted-scores" in f for f in seen[0].inputFiles()) and seen[0].count() == 100 * (1 + 2 * len(models.FEATURES))
