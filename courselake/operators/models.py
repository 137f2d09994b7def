"""Baselines and MLlib models on the snapshot features.

A fitted model is a ``PipelineModel`` that starts from snapshot columns: its first
stage fills, scales and derives the inputs in SQL with the fitted numbers written
into the statement, so preprocessing is saved and loaded with the model. Only the
fitted numbers (a few per feature) reach the driver.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courselake.functions.permutation import ROUNDS, permuted, round_keys
from courselake.operators import newton
from courselake.operators.evaluation import evaluate
from courselake.operators.masks import leaf_masks
from courselake.operators.prep import (
    apply_imputer,
    class_weights,
    fit_imputer,
    fit_mode,
    fit_scaler,
    one_hot,
    weigh,
)
from courselake.operators.quality import require_columns
from courselake.operators.trees import stored
from courselake.schemas import (
    ASSESSMENT_TARGET,
    ATTEMPT_WEEK,
    CATEGORICAL_FEATURES,
    DEMOGRAPHICS,
    NUMERIC_FEATURES,
    RANDOM_SEED,
    WITHDRAWAL_TARGET,
)
from courselake.session import partitions_for

FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
COPIES_PER_TASK = 200_000  # shuffled rows that a task makes and scores


def model_frame(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the presentation term; raises when a feature or label is absent."""
    derived = snapshots
    if "code_presentation" in snapshots.columns:
        derived = snapshots.withColumn("presentation_term", F.right("code_presentation", F.lit(1)))
    require_columns(derived, [*FEATURES, ASSESSMENT_TARGET, WITHDRAWAL_TARGET])
    assert_feature_contract(FEATURES)
    return derived


def assert_feature_contract(features: list[str]) -> None:
    """Demographics and labels never enter a model."""
    banned = set(DEMOGRAPHICS) | {ASSESSMENT_TARGET, WITHDRAWAL_TARGET}
    entered = sorted(banned & set(features))
    if entered:
        raise ValueError(f"Columns that must not be features: {entered}")


def prevalence(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Scores every row with the event rate of the training split."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn("probability", rate)


def rule_baseline(train: DataFrame, df: DataFrame, q: float = 0.75) -> DataFrame:
    """Scores 1 when inactive for long (or never active), missing work, or slowing down."""
    limit = train.agg(F.percentile("days_since_activity", q)).scalar()
    inactive = F.coalesce(F.col("days_since_activity") > limit, F.lit(True))
    alert = inactive | (F.col("missing_due_to_date") > 0) | (F.col("engagement_change") < 0)
    return df.withColumn("probability", F.when(alert, 1.0).otherwise(0.0))


def rule_threshold(train: DataFrame, q: float = 0.75) -> DataFrame:
    """One row: the inactivity limit of the rule."""
    return train.agg(F.percentile("days_since_activity", q).alias("rule_inactivity_threshold_days"))


def _number(value: float | None) -> str:
    if value is None or math.isnan(value):
        return "CAST(NULL AS DOUBLE)"
    return f"{value!r}D"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def preparation(train: DataFrame) -> list:
    """Fitted stages from snapshot columns to ``features``; the fits of one split share them."""
    imputer = fit_imputer(train, NUMERIC_FEATURES)
    medians = imputer.first()
    scales = fit_scaler(apply_imputer(train, imputer), NUMERIC_FEATURES).first()
    modes = fit_mode(train, CATEGORICAL_FEATURES).first()
    inputs = [
        f"(coalesce(CAST({c} AS DOUBLE), {_number(medians[c])}) - {_number(scales[c].mean)})"
        f" / {_number(scales[c].scale)} AS {c}_in"
        for c in NUMERIC_FEATURES
    ] + [f"coalesce({c}, {_quoted(modes[c])}) AS {c}_in" for c in CATEGORICAL_FEATURES]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(inputs)} FROM __THIS__")
    filled = [f"{c}_in" for c in CATEGORICAL_FEATURES]
    assemble = VectorAssembler(
        inputCols=[f"{c}_in" for c in NUMERIC_FEATURES] + [f"{c}_hot" for c in filled],
        outputCol="features",
    )
    return Pipeline(stages=[prepare, *one_hot(filled), assemble]).fit(train).stages


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the entries of the feature vector."""
    index = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    names = [f"numeric__{c}" for c in NUMERIC_FEATURES]
    for column, values in zip(CATEGORICAL_FEATURES, index.labelsArray):
        names += [f"categorical__{column}_{v}" for v in values]
    return names


def _prepared(train: DataFrame, label: str, stages: list) -> DataFrame:
    """Label, balanced weight and feature vector of the training rows."""
    weights = class_weights(train, label)
    return PipelineModel(stages).transform(weigh(train, label, weights)).select(
        F.col(label).cast("double").alias("label"), "weight", "features"
    )


def _fit(train: DataFrame, label: str, estimator, stages: list | None) -> PipelineModel:
    """The estimator fitted on the prepared training rows, after the stages that prepare them."""
    stages = stages or preparation(train)
    return PipelineModel([*stages, estimator.fit(_prepared(train, label, stages))])


def _as_mllib(numbers: list[float]) -> LogisticRegressionModel:
    """Coefficients and, last, the intercept as MLlib's model, which scores, saves and loads."""
    return LogisticRegressionModel(
        LogisticRegressionModel._new_java_obj(
            "org.apache.spark.ml.classification.LogisticRegressionModel",
            f"LogisticRegression_{uuid.uuid4().hex[:12]}",
            Vectors.dense(numbers[:-1]),
            numbers[-1],
        )
    )


def fit_logistic(
    train: DataFrame,
    label: str = ASSESSMENT_TARGET,
    C: float = 0.5,
    max_iter: int = 1000,
    stages: list | None = None,
) -> PipelineModel:
    """L2 logistic regression, balanced classes.

    The objective sums the weighted loss times C plus half the squared norm. Its optimum is found by
    Newton steps, a pass over the stored rows each and fewer than ten whatever the inputs' scales and
    dependences (the clicks of 14 days are a sum of two others); MLlib's search takes hundreds.
    Where a class is absent no optimum exists and MLlib gives the limit.
    """
    present = train.select(F.col(label).cast("double").alias("label")).distinct().limit(3).collect()
    if {r["label"] for r in present} == {0.0, 1.0}:
        stages = stages or preparation(train)
        prepared = _prepared(train, label, stages)
        width = len(prepared.select("features").first()["features"])
        inputs = vector_to_array("features")
        rows = stored(
            prepared.select(*[inputs[i].alias(f"x{i}") for i in range(width)], "label", "weight"), "logistic-rows"
        )
        fitted = newton.fit_newton_vectors(rows, [f"x{i}" for i in range(width)], C, most_steps=max_iter)
        return PipelineModel([*stages, _as_mllib(fitted.coefficients.tolist())])
    rows = train.count()
    estimator = LogisticRegression(
        regParam=1.0 / (C * rows),
        elasticNetParam=0.0,
        standardization=False,
        weightCol="weight",
        maxIter=max_iter,
        tol=1e-8,
    )
    return _fit(train, label, estimator, stages)


def fit_tree(
    train: DataFrame,
    label: str = ASSESSMENT_TARGET,
    depth: int = 5,
    leaf: int = 100,
    stages: list | None = None,
) -> PipelineModel:
    """Decision tree, balanced classes. Splits are binned, so cut points are approximate."""
    estimator = DecisionTreeClassifier(
        maxDepth=depth,
        minInstancesPerNode=leaf,
        weightCol="weight",
        maxBins=256,
        seed=RANDOM_SEED,
    )
    return _fit(train, label, estimator, stages)


def fit_gbt(
    train: DataFrame,
    label: str = ASSESSMENT_TARGET,
    depth: int = 6,
    rate: float = 0.08,
    rounds: int = 150,
    stages: list | None = None,
) -> PipelineModel:
    """Boosted trees, unweighted. MLlib has no leaf penalty, so scores differ somewhat."""
    estimator = GBTClassifier(
        maxDepth=depth, stepSize=rate, maxIter=rounds, maxBins=256, seed=RANDOM_SEED,
        minInstancesPerNode=20,  # fixed value: smallest leaf of the boosted trees
    )
    return _fit(train, label, estimator, stages)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds the event probability and, if the model has one, the margin.

    Boosted trees are read side by side in Arrow batches; MLlib follows each row through each tree.
    """
    kept = [c for c in df.columns if c != "probability"]
    scorer = leaf_masks(model.stages[-1]) if isinstance(model.stages[-1], GBTClassificationModel) else None
    if scorer is not None:
        margin = scorer(vector_to_array("features"))
        out = PipelineModel(model.stages[:-1]).transform(df).select(*kept, margin.alias("margin"))
        # MLlib's probability of the event, one less that of the other class
        return out.select(*kept, (1.0 - 1.0 / (1.0 + F.exp(2.0 * F.col("margin")))).alias("probability"), "margin")
    out = model.transform(df)
    positive = vector_to_array("probability")[1].alias("probability")
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    return out.select(*kept, positive, margin)


CONTRACT_ROLE = "role"


def feature_contract(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """No rows, a column per feature of ``df`` that says so in its metadata, with its type."""
    features = FEATURES if features is None else features
    require_columns(df, features)
    assert_feature_contract(features)
    return df.limit(0).select(
        *[F.col(f).alias(f, metadata={CONTRACT_ROLE: "feature"}) for f in features]
    )


def contract_faults(df: DataFrame, contract: DataFrame) -> list[str]:
    """What keeps a frame from being scored: absent features and features of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    faults = []
    for f in contract.schema.fields:
        if f.metadata.get(CONTRACT_ROLE) != "feature":
            continue
        if f.name not in have:
            faults.append(f"{f.name} is missing")
        elif have[f.name] != f.dataType.simpleString():
            faults.append(f"{f.name} is {have[f.name]} instead of {f.dataType.simpleString()}")
    return faults


def save_model(model: PipelineModel, train: DataFrame, path: str) -> None:
    """The pipeline and, beside it, the contract of the frame it was fitted on."""
    feature_contract(train).write.mode("overwrite").parquet(f"{path}/contract")
    model.write().overwrite().save(f"{path}/pipeline")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """(pipeline, contract); raises when the contract names a column that must not be a feature."""
    contract = spark.read.parquet(f"{path}/contract")
    entered = [f.name for f in contract.schema.fields if f.metadata.get(CONTRACT_ROLE) == "feature"]
    if not entered:
        raise ValueError(f"No feature contract in {path}")
    assert_feature_contract(entered)
    return PipelineModel.load(f"{path}/pipeline"), contract


def score_by_contract(loaded: tuple[PipelineModel, DataFrame], df: DataFrame) -> DataFrame:
    """Scores of a loaded model; raises before any job when the frame breaks its contract."""
    model, contract = loaded
    faults = contract_faults(df, contract)
    if faults:
        raise ValueError(f"The frame breaks the model's contract: {'; '.join(faults)}")
    return score(model, df)


def fit_sigmoid(scored_validation: DataFrame) -> LogisticRegressionModel:
    """Sigmoid calibration of a margin on the validation split.

    The targets are smoothed: an event counts (events + 1) / (events + 2) and a
    non-event 1 / (non-events + 2). They are the labels of an unpenalised one-feature regression
    over the stored margins, fitted by Newton steps. Margins that are all equal get the slope 0.
    """
    totals = scored_validation.agg(
        F.sum(F.col("y").cast("double")).alias("events"),
        F.sum(1.0 - F.col("y")).alias("others"),
        F.min("margin").alias("least"),
        F.max("margin").alias("most"),
    ).first()
    target = F.when(
        F.col("y") == 1, (totals.events + 1.0) / (totals.events + 2.0)
    ).otherwise(1.0 / (totals.others + 2.0))
    rows = stored(scored_validation.select("margin", target.alias("target")), "margins")
    if totals.least == totals.most:
        share = rows.agg(F.avg("target")).first()[0]
        return _as_mllib([0.0, math.log(share / (1.0 - share))])
    fitted = newton.fit_newton(
        rows, ["margin"], [F.col("margin")], F.col("target"), F.lit(1.0), C=1.0, penalty=0.0
    )
    return _as_mllib(fitted.coefficients.tolist())


def apply_sigmoid(model: LogisticRegressionModel, scored: DataFrame) -> DataFrame:
    """Calibrated probability from the margin, as a plain column expression."""
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    line = F.lit(slope) * F.col("margin") + F.lit(intercept)
    return scored.withColumn("probability", 1.0 / (1.0 + F.exp(-line)))


def coefficients(model: PipelineModel) -> DataFrame:
    """Coefficient and odds ratio per feature, smallest first. One row per feature."""
    values = model.stages[-1].coefficients.toArray().tolist()
    names = feature_names(model)
    return (
        SparkSession.active()
        .createDataFrame(list(zip(names, values)), "feature string, coefficient double")
        .withColumn("odds_ratio", F.exp("coefficient"))
        .orderBy("coefficient", "feature")
    )


def numbered_rows(df: DataFrame, seed: int = RANDOM_SEED) -> DataFrame:
    """``df`` with ``_row``: 0, 1, 2 .. in the order of a hash of the key.

    Counted per hash bucket; a window inside the bucket and one over the bucket counts give
    the number, so no task sees more than a bucket or the list of buckets.
    """
    key = F.concat_ws("|", *ATTEMPT_WEEK, F.lit(seed))
    digest = F.substring(F.md5(key.cast("binary")), 1, 13)
    ordered = df.withColumn("_order", F.conv(digest, 16, 10).cast("long")).withColumn(
        "_bucket", F.shiftright("_order", 36)
    )
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_order", *ATTEMPT_WEEK)
    return (
        ordered.join(offsets, "_bucket")
        .withColumn("_row", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_order", "_bucket", "_offset")
    )


def with_donors(
    numbered: DataFrame, n: int, features: list[str], repeats: int, seed: int = RANDOM_SEED
) -> DataFrame:
    """Each of n numbered rows once per feature and repeat, with the row ``_donor`` it takes the
    feature's value from: a keyed permutation of the numbers, another for each feature and repeat."""
    draws = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(r).alias("repeat"),
            F.array(*[F.lit(k).cast("long") for k in round_keys(seed, f"{f}:{r}")]).alias("keys"),
        )
        for f in features
        for r in range(repeats)
    ]
    keys = [F.col("_draw.keys")[i] for i in range(ROUNDS)]
    return (
        numbered.withColumn("_draw", F.explode(F.array(*draws)))
        .withColumns(
            {
                "feature": F.col("_draw.feature"),
                "repeat": F.col("_draw.repeat"),
                "_donor": permuted(F.col("_row").cast("long"), max(n, 1), keys),
            }
        )
        .drop("_draw")
    )


def permuted_copies(df: DataFrame, repeats: int, seed: int = RANDOM_SEED) -> DataFrame:
    """All rows once per feature and repeat, with that feature shuffled among them.

    Rows are numbered in a random order, once, and stored. Every feature and repeat has a permutation
    of the numbers of its own, so the losses are independent draws; the values are met by an even
    join on the number. The few rows of a table become many copies, so they are dealt out by the
    number of copies first: AQE merges partitions by their size before the copies are made.
    """
    numbered = stored(numbered_rows(df, seed), "numbered-rows")
    n = numbered.count()
    tasks = partitions_for(n * len(FEATURES) * repeats, 1, COPIES_PER_TASK)
    drawn = with_donors(numbered.repartition(tasks, "_row"), n, FEATURES, repeats, seed)
    donors = numbered.select(F.col("_row").alias("_donor"), F.struct(*FEATURES).alias("_values"))
    kept = [c for c in df.columns if c not in FEATURES]
    # every donor exists; a left join can broadcast the donors only, never the copies
    return drawn.join(donors, "_donor", "left").select(
        *kept,
        "feature",
        "repeat",
        *[
            F.when(F.col("feature") == f, F.col("_values")[f]).otherwise(F.col(f)).alias(f)
            for f in FEATURES
        ],
    )


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    label: str = ASSESSMENT_TARGET,
    repeats: int = 3,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Loss of average precision when a feature is shuffled, over all rows.

    The scores of all copies are stored, as their evaluation reads them several times.
    """
    whole = df.withColumns({"feature": F.lit("-"), "repeat": F.lit(0)})
    frame = whole.unionByName(permuted_copies(df, repeats, seed))
    scored = score(model, frame).select("feature", "repeat", F.col(label).alias("y"), "probability")
    quality = evaluate(stored(scored, "permuted-scores"), by=("feature", "repeat")).select("feature", "repeat", "pr_auc")
    base = quality.filter("feature = '-'").select("pr_auc").scalar()
    loss = quality.filter("feature <> '-'").withColumn("loss", base - F.col("pr_auc"))
    return (
        loss.groupBy("feature")
        .agg(
            F.avg("loss").alias("importance_mean"),
            F.stddev_pop("loss").alias("importance_std"),
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )
