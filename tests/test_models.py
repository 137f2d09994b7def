import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from courselake.operators import evaluation, models, prep
from courselake.plans import forecast
from courselake.schemas import (
    ASSESSMENT_TARGET,
    DEMOGRAPHICS,
    NUMERIC_FEATURES,
    RANDOM_SEED,
)


@pytest.fixture(scope="module")
def train(lake):
    return lake.split("train")


@pytest.fixture(scope="module")
def logistic(train):
    return models.fit_logistic(train)


def test_contract(spark):
    df = spark.createDataFrame(
        [("AAA", "2013J", 0)],
        f"code_module string, code_presentation string, {ASSESSMENT_TARGET} int",
    )
    with pytest.raises(ValueError, match="missing"):
        models.model_frame(df)
    with pytest.raises(ValueError, match="gender"):
        models.assert_feature_contract([*models.FEATURES, "gender"])
    assert not set(models.FEATURES) & set(DEMOGRAPHICS)
    assert RANDOM_SEED == 20260723


def test_imputers_and_scaler(spark):
    df = spark.createDataFrame(
        [(1.0, "b", 5), (2.0, "a", 5), (None, "a", 5), (10.0, "b", 5), (4.0, None, 5)],
        "x double, c string, k int",
    )
    assert prep.fit_imputer(df, ["x"]).first().x == 3.0
    assert prep.fit_mode(df, ["c"]).first().c == "a"
    filled = prep.apply_imputer(prep.apply_imputer(df, prep.fit_imputer(df, ["x"])),
                                prep.fit_mode(df, ["c"]))
    assert filled.filter("x IS NULL OR c IS NULL").count() == 0
    scaled = prep.apply_scaler(filled, prep.fit_scaler(filled, ["x", "k"])).toPandas()
    assert scaled.x.mean() == pytest.approx(0) and scaled.x.std(ddof=0) == pytest.approx(1)
    assert list(scaled.k) == [0.0] * 5


def test_one_hot_unknown_is_all_zeros(spark):
    known = spark.createDataFrame([("a",), ("b",)], "c string")
    encoder = Pipeline(stages=prep.one_hot(["c"])).fit(known)
    rows = encoder.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"))
    got = {r.c: list(r.v) for r in rows.select("c", vector_to_array("c_hot").alias("v")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0]}


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    weights = prep.class_weights(df, "y")
    assert {r.label: r.weight for r in weights.collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    assert prep.weigh(df, "y", weights).agg(F.sum("weight")).first()[0] == pytest.approx(4.0)


def newton(x, y, w, penalty):
    """Weighted logistic loss plus half the penalised squared norm, intercept free."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x1.shape[1])
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ b))
        grad = x1.T @ (w * (p - y)) + ridge * b
        hess = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge)
        b -= np.linalg.lstsq(hess, grad, rcond=None)[0]
    return b


def test_logistic_solves_its_objective(train, logistic):
    weights = prep.class_weights(train, ASSESSMENT_TARGET)
    rows = prep.weigh(PipelineModel(logistic.stages[:-1]).transform(train), ASSESSMENT_TARGET, weights)
    table = rows.select(vector_to_array("features").alias("x"), "weight",
                        F.col(ASSESSMENT_TARGET).alias("y")).toPandas()
    x = np.array(table.x.tolist())
    solved = newton(x, table.y.to_numpy(), table.weight.to_numpy(), 2.0)
    fitted = logistic.stages[-1].coefficients.toArray()
    assert fitted == pytest.approx(solved[:-1], abs=2e-3)
    names = models.feature_names(logistic)
    assert len(names) == x.shape[1] == len(fitted)
    table = models.coefficients(logistic).toPandas()
    assert list(table.coefficient) == sorted(table.coefficient)
    assert list(table.odds_ratio) == pytest.approx(list(np.exp(table.coefficient)))


def test_sigmoid_solves_smoothed_targets(lake, logistic):
    validation = models.score(logistic, lake.split("validation")).withColumn(
        "y", F.col(ASSESSMENT_TARGET)
    )
    fitted = models.fit_sigmoid(validation)
    table = validation.select("margin", "y").toPandas()
    events, others = (table.y == 1).sum(), (table.y == 0).sum()
    target = np.where(table.y == 1, (events + 1) / (events + 2), 1 / (others + 2))
    x = np.concatenate([table.margin, table.margin])[:, None]
    y = np.concatenate([np.ones(len(table)), np.zeros(len(table))])
    solved = newton(x, y, np.concatenate([target, 1 - target]), 0.0)
    assert float(fitted.coefficients[0]) == pytest.approx(solved[0], rel=1e-3, abs=1e-4)
    assert fitted.intercept == pytest.approx(solved[1], rel=1e-3, abs=1e-4)
    line = solved[0] * table.margin + solved[1]
    got = models.apply_sigmoid(fitted, validation).agg(F.avg("probability")).first()[0]
    assert got == pytest.approx((1 / (1 + np.exp(-line))).mean(), abs=1e-4)


def test_model_survives_saving(spark, lake, logistic, tmp_path):
    path = str(tmp_path / "model")
    logistic.write().overwrite().save(path)
    rows = lake.split("test").limit(200)
    before = models.score(logistic, rows).agg(F.sum("probability")).first()[0]
    after = models.score(PipelineModel.load(path), rows).agg(F.sum("probability")).first()[0]
    assert before == pytest.approx(after)


def test_rule_counts_unknown_activity_as_inactive(spark):
    columns = "days_since_activity int, missing_due_to_date int, engagement_change int"
    train = spark.createDataFrame([(i, 0, 0) for i in range(5)], columns)
    df = spark.createDataFrame([(3, 0, 0), (4, 0, 0), (None, 0, 0), (0, 1, 0), (0, 0, -1)], columns)
    got = [r.probability for r in models.rule_baseline(train, df).collect()]
    assert got == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_permutation_copies_shuffle_one_column(lake):
    rows = lake.split("test")
    n = rows.count()
    numbers = [r._row for r in models.numbered_rows(rows).select("_row").collect()]
    assert sorted(numbers) == list(range(n))
    copies = models.permuted_copies(rows, 2).toPandas()
    base = rows.toPandas()
    assert len(copies) == n * 2 * len(models.FEATURES)
    one = copies[(copies.feature == "clicks_to_date") & (copies.repeat == 1)]
    assert sorted(one.clicks_to_date) == sorted(base.clicks_to_date)
    key = ["code_module", "code_presentation", "id_student", "course_week"]
    one, base = one.set_index(key), base.set_index(key)
    assert one.clicks_7d.to_dict() == base.clicks_7d.to_dict()
    assert one.clicks_to_date.to_dict() != base.clicks_to_date.to_dict()


def test_forecast_run_is_deterministic_and_complete(spark, lake, tmp_path):
    runs = [
        forecast.run_forecast(lake.snapshots, str(tmp_path / f"run{i}"), rounds=3)
        for i in range(2)
    ]
    first, second = (
        r["model_metrics"].orderBy("model", "split").toPandas().round(9) for r in runs
    )
    pd.testing.assert_frame_equal(first, second)
    assert len(first) == 11
    assert first.roc_auc.between(0, 1).all()
    constant = first[first.model == "prevalence_baseline"]
    assert list(constant.roc_auc) == [0.5, 0.5]
    written = spark.read.option("header", "true").csv(str(tmp_path / "run0/tables/model_metrics"))
    assert written.count() == 11
    assert spark.read.json(str(tmp_path / "run0/model-run")).first().random_seed == RANDOM_SEED
    assert set(NUMERIC_FEATURES) <= {
        r.feature for r in runs[0]["permutation_importance"].collect()
    }
    assert evaluation.confusion(lake.scored).count() == 1


def test_newton_reaches_the_optimum_that_mllib_approaches(train, logistic):
    from courselake.operators import newton
    from courselake.operators.trees import stored

    weights = prep.class_weights(train, ASSESSMENT_TARGET)
    prepared = PipelineModel(logistic.stages[:-1]).transform(prep.weigh(train, ASSESSMENT_TARGET, weights))
    rows = stored(
        prepared.select(vector_to_array("features").alias("x"), F.col(ASSESSMENT_TARGET).cast("double").alias("y"), "weight"), "rows"
    )
    names = models.feature_names(logistic)
    inputs = [F.get("x", F.lit(i)) for i in range(len(names))]
    fitted = newton.fit_newton(rows, names, inputs, F.col("y"), F.col("weight"))
    mllib = np.r_[logistic.stages[-1].coefficients.toArray(), logistic.stages[-1].intercept]
    assert fitted.coefficients == pytest.approx(mllib, abs=2e-3)
    assert np.abs(fitted.gradient).max() < 1e-4
    again = newton.fit_newton(rows, names, inputs, F.col("y"), F.col("weight"), start=mllib)
    assert again.objective == pytest.approx(fitted.objective) and again.steps <= fitted.steps
    gradient, _, loss = newton.sums_at(rows, inputs, F.col("y"), F.col("weight"), mllib)
    assert 0.5 * loss + mllib[:-1] @ mllib[:-1] / 2 >= fitted.objective - 1e-6


def test_newton_survives_separable_and_huge_inputs(spark):
    from courselake.operators import newton

    rows = spark.createDataFrame([(float(x), float(x > 0)) for x in range(-20, 21)] + [(1e4, 1.0), (-1e4, 0.0)], "x double, y double").cache()
    fitted = newton.fit_newton(rows, ["x"], [F.col("x")], F.col("y"), F.lit(1.0))
    assert np.isfinite(fitted.coefficients).all() and fitted.decrement < 1e-9
    assert fitted.table(spark).count() == 2


def test_fits_that_share_a_preparation_are_those_that_do_not(train, logistic):
    stages = models.preparation(train)
    shared = models.fit_logistic(train, stages=stages)
    assert shared.stages[-1].coefficients.toArray() == pytest.approx(logistic.stages[-1].coefficients.toArray(), abs=1e-9)
    assert shared.stages[:-1] == stages
