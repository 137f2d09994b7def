"""Evaluation of a scored frame: columns ``y`` (0 or 1), ``probability`` and the grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courselake.functions.columns import one_row
from courselake.functions.ranking import exact_quantiles, with_prefix_sums
from courselake.schemas import ATTEMPT, DEMOGRAPHICS

# The dimensions metrics are broken down by.
GROUP_DIMENSIONS = ["course_week", "code_module", "code_presentation", "gender", "age_band"]


def score_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Positive and negative rows per group and distinct score."""
    return scored.groupBy(*by, "probability").agg(
        F.sum(F.col("y").cast("long")).alias("positives"),
        F.sum((1 - F.col("y")).cast("long")).alias("negatives"),
    )


def confusion(
    scored: DataFrame, by: tuple[str, ...] = ("model",), cutoff: float = 0.5
) -> DataFrame:
    """Confusion counts at a cutoff."""
    flagged, event = F.col("probability") >= cutoff, F.col("y") == 1
    return scored.groupBy(*by).agg(
        F.count_if(~flagged & ~event).alias("true_negative"),
        F.count_if(flagged & ~event).alias("false_positive"),
        F.count_if(~flagged & event).alias("false_negative"),
        F.count_if(flagged & event).alias("true_positive"),
    )


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 0.0).otherwise(
        numerator.cast("double") / F.nullif(denominator, F.lit(0))
    )


def _rates() -> dict[str, Column]:
    """Rates from confusion counts; an undefined ratio is 0."""
    tn, fp = F.col("true_negative"), F.col("false_positive")
    fn, tp = F.col("false_negative"), F.col("true_positive")
    n = tn + fp + fn + tp
    return {
        "n": n,
        "prevalence": (fn + tp) / n,
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
        "accuracy": (tp + tn) / n,
        "flag_rate": (tp + fp) / n,
    }


def threshold_metrics(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1, accuracy, flag rate and prevalence from confusion counts."""
    return counts.select(*by, *[c.alias(r) for r, c in _rates().items()])


def evaluate(
    scored: DataFrame, by: tuple[str, ...] = ("model", "split"), cutoff: float = 0.5
) -> DataFrame:
    """All metrics per group from one frame of counts per distinct score.

    With the rows ranked by falling score, a score contributes its negatives times
    the positives above (half for a tie) to the ROC area, and its positives times
    the precision reached to the average precision.
    """
    by = list(by)
    ranked = with_prefix_sums(
        score_counts(scored, by), by, "probability", ["positives", "negatives"], descending=True
    )
    p = F.col("probability")
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    above = F.col("before_positives").cast("double")
    reached = above + pos
    seen = reached + F.col("before_negatives").cast("double") + neg
    flagged = p >= cutoff
    sums = ranked.groupBy(*by).agg(
        F.sum(F.when(flagged, F.col("positives")).otherwise(0)).alias("true_positive"),
        F.sum(F.when(flagged, F.col("negatives")).otherwise(0)).alias("false_positive"),
        F.sum("positives").alias("events"),
        F.sum("negatives").alias("non_events"),
        F.sum(neg * above + pos * neg * F.lit(0.5)).alias("pairs_won"),
        F.sum(pos * reached / seen).alias("precision_sum"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("squared_error"),
    )
    events, non_events = F.col("events"), F.col("non_events")
    counts = sums.withColumns(
        {
            "false_negative": events - F.col("true_positive"),
            "true_negative": non_events - F.col("false_positive"),
        }
    )
    n = events + non_events
    areas = {
        "roc_auc": F.when(
            (events > 0) & (non_events > 0),
            F.col("pairs_won") / (events.cast("double") * non_events.cast("double")),
        ),
        "pr_auc": _or_zero(F.col("precision_sum"), events),
        "brier": F.col("squared_error") / n,
    }
    rates = _rates()
    return counts.select(
        *by,
        *[rates[r].alias(r) for r in ["n", "prevalence", "precision", "recall", "f1", "accuracy"]],
        *[c.alias(a) for a, c in areas.items()],
        rates["flag_rate"].alias("flag_rate"),
    )


def predictions(scored: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Scored rows with the decision and the days left to the next due day."""
    return scored.select(
        *ATTEMPT,
        "course_week",
        "snapshot_day",
        *DEMOGRAPHICS,
        "next_assessment_due_day",
        "y",
        "probability",
        F.when(F.col("probability") >= cutoff, 1).otherwise(0).alias("prediction"),
        (F.col("next_assessment_due_day") - F.col("snapshot_day")).alias(
            "prediction_horizon_days"
        ),
    )


def calibration_bins(scored: DataFrame, q: int = 10) -> DataFrame:
    """Mean score and event rate in quantile bins, closed on the right.

    Equal edges are dropped, so ties never straddle a bin.
    """
    edges = exact_quantiles(scored, "probability", [i / q for i in range(q + 1)]).select(
        F.array_distinct("quantiles").alias("edges")
    )
    inner = one_row(edges)["edges"]
    below = F.size(F.filter(F.col("edges"), lambda e: e < F.col("probability")))
    binned = scored.select("y", "probability", inner.alias("edges")).select(
        "y", "probability", F.greatest(F.lit(1), below).alias("bin")
    )
    return binned.groupBy("bin").agg(
        F.avg("probability").alias("mean_predicted_probability"),
        F.avg("y").alias("observed_event_rate"),
        F.count(F.lit(1)).alias("records"),
    )


def cutoffs(lo: float = 0.1, hi: float = 0.9, n: int = 17) -> list[float]:
    """Evenly spaced cutoffs, both ends included."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def threshold_sweep(
    predicted: DataFrame, lo: float = 0.1, hi: float = 0.9, n: int = 17
) -> DataFrame:
    """Alerts at each cutoff.

    Every row is counted once under the number of cutoffs it reaches. The sweep then
    runs on that histogram (cutoffs x label x lead days), not on the rows.
    """
    marks = cutoffs(lo, hi, n)
    reached = sum((F.when(F.col("probability") >= t, 1).otherwise(0) for t in marks), F.lit(0))
    histogram = predicted.groupBy(
        reached.alias("reached"), "y", F.col("prediction_horizon_days").alias("lead")
    ).agg(F.count(F.lit(1)).alias("rows"))
    event = F.col("y") == 1
    totals = one_row(
        histogram.agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(event, F.col("rows")).otherwise(0)).alias("events"),
        )
    )
    alerts = (
        histogram.filter("reached > 0")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("reached"))))
        .groupBy("step")
        .agg(
            F.sum("rows").alias("flagged"),
            F.sum(F.when(event, F.col("rows")).otherwise(0)).alias("hits"),
            F.percentile(F.when(event, F.col("lead")), 0.5, F.col("rows")).alias("median_lead"),
        )
    )
    steps = predicted.sparkSession.createDataFrame(
        [(i + 1, t) for i, t in enumerate(marks)], "step int, threshold double"
    )
    flagged = F.coalesce("flagged", F.lit(0))
    hits = F.coalesce("hits", F.lit(0))
    return steps.join(alerts, "step", "left").select(
        "threshold",
        flagged.alias("records_flagged"),
        (flagged / totals["rows"]).alias("flag_rate"),
        _or_zero(hits, flagged).alias("precision"),
        _or_zero(hits, totals["events"]).alias("recall"),
        hits.alias("true_alerts"),
        (flagged - hits).alias("false_alerts"),
        ((flagged - hits) / F.nullif(hits, F.lit(0))).alias("false_alerts_per_true_alert"),
        F.col("median_lead").alias("median_true_alert_lead_days"),
    )


def grouped_metrics(
    scored: DataFrame,
    dimensions: list[str] = GROUP_DIMENSIONS,
    min_rows: int = 100,
    cutoff: float = 0.5,
) -> DataFrame:
    """Metrics per value of each dimension; small and one-class groups are left out."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.coalesce(F.col(d).cast("string"), F.lit("nan")).alias("group"),
            )
            for d in dimensions
        ]
    )
    long = scored.select("y", "probability", F.explode(pairs).alias("g")).select(
        "y", "probability", "g.dimension", "g.group"
    )
    return evaluate(long, by=("dimension", "group"), cutoff=cutoff).filter(
        (F.col("n") >= min_rows) & F.col("roc_auc").isNotNull()
    )
