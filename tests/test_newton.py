"""The Newton fit where the objective is a sum over many rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courselake.operators import models, newton


def rows_of(spark, n=400, seed=5):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 2)
        rows.append((a, b, float(r.random() < 1 / (1 + np.exp(-a + b / 2))), r.choice([0.5, 1.5])))
    return spark.createDataFrame(rows, "a double, b double, y double, weight double")


def test_rounding_of_the_objective_costs_no_steps(spark, monkeypatch):
    rows = rows_of(spark).cache()
    inputs = [F.col("a"), F.col("b")]
    plain = newton.fit_newton(rows, ["a", "b"], inputs, F.col("y"), F.col("weight"))
    seen, exact = [], newton.sums_at

    def rounded(*args):
        gradient, curvature, loss = exact(*args)
        seen.append(loss)
        return gradient, curvature, loss * (1 + 5e-12 * len(seen))  # as a sum over millions of rows

    monkeypatch.setattr(newton, "sums_at", rounded)
    fitted = newton.fit_newton(rows, ["a", "b"], inputs, F.col("y"), F.col("weight"))
    assert fitted.coefficients == pytest.approx(plain.coefficients, abs=1e-9)
    assert len(seen) <= 10


def test_vector_sums_are_those_of_sql(spark):
    rows = rows_of(spark).repartition(3)
    columns = rows.select(F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("y").alias("label"), "weight")
    for point in (np.zeros(3), np.array([40.0, -900.0, 3.0])):
        own = newton.vector_sums_at(columns, 3, point)
        sql = newton.sums_at(rows, [F.col("a"), F.col("b")], F.col("y"), F.col("weight"), point)
        for x, y in zip(own, sql):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_logistic_reaches_the_optimum_with_dependent_inputs_in_few_passes(lake, monkeypatch):
    train = lake.split("train")
    seen, exact = [], newton.vector_sums_at

    def counted(*args):
        seen.append(exact(*args))
        return seen[-1]

    monkeypatch.setattr(newton, "vector_sums_at", counted)
    fitted = models.fit_logistic(train).stages[-1]
    assert 2 <= len(seen) <= 12
    gradient = 0.5 * seen[-1][0] + np.r_[fitted.coefficients.toArray(), 0.0]
    assert np.abs(gradient).max() < 1e-5


def test_sigmoid_of_equal_margins(spark):
    scored = spark.createDataFrame([(0.7, 1), (0.7, 0), (0.7, 0)], "margin double, y int")
    fitted = models.fit_sigmoid(scored)
    assert float(fitted.coefficients[0]) == 0.0
    assert 1 / (1 + np.exp(-fitted.intercept)) == pytest.approx((2 / 3 + 1 / 4 + 1 / 4) / 3)
