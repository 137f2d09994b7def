"""Boosted trees read as leaf masks score as MLlib does."""

from __future__ import annotations

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from courselake.operators import masks, models, prep


def _rows(spark, n=1500):
    data = [
        (i, (i * 7919 % 1009) / 37.0 - 9.0, float(i % 17), "abc"[i * 31 % 3], int((i * 7919 % 1009 > 400) ^ (i % 17 > 9) ^ (i % 11 == 0)))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id int, x double, z double, c string, label int").repartition(3)


@pytest.fixture(scope="module", params=[1, 6])
def fitted(spark, request):
    stages = [
        *prep.one_hot(["c"]),
        VectorAssembler(inputCols=["x", "z", "c_hot"], outputCol="features", handleInvalid="keep"),
        GBTClassifier(maxDepth=request.param, stepSize=0.3, maxIter=7, maxBins=64, seed=1),
    ]
    return Pipeline(stages=stages).fit(_rows(spark))


def test_margins_and_probabilities_are_those_of_mllib(spark, fitted):
    odd = [
        (-1, math.nan, math.nan, "zz", 0), (-2, math.inf, -math.inf, "a", 1), (-3, -math.inf, math.inf, "b", 0), (-4, -0.0, 0.0, "c", 1)
    ]
    rows = _rows(spark).unionByName(spark.createDataFrame(odd, "id int, x double, z double, c string, label int"))
    rows = rows.withColumn("probability", F.lit("old"))
    got = {r["id"]: r for r in models.score(fitted, rows).collect()}
    want = fitted.transform(rows.drop("probability")).select(
        "id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m")
    ).collect()
    assert len(got) == len(want) == 1504
    for r in want:
        assert got[r["id"]]["margin"] == pytest.approx(r["m"], abs=1e-12)
        assert got[r["id"]]["probability"] == pytest.approx(r["p"], abs=1e-12)
    assert models.score(fitted, rows).columns == ["id", "x", "z", "c", "label", "probability", "margin"]
    assert models.score(fitted, rows.limit(0)).count() == 0


def test_boosted_scores_come_from_arrow_batches(spark, fitted):
    plan = models.score(fitted, _rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_trees_of_more_leaves_than_bits_are_left_to_mllib(spark, monkeypatch, fitted):
    monkeypatch.setattr(masks, "LEAVES", 1)
    assert masks.leaf_masks(fitted.stages[-1]) is None
    assert isinstance(fitted, PipelineModel) and models.score(fitted, _rows(spark)).count() == 1500
