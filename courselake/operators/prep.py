"""Preprocessing fitted on the training split: imputation, scaling, encoding, weights.

Fitted statistics are one-row frames. They are applied as scalar subqueries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.functions.columns import one_row


def fit_imputer(train: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians of the non-null values. One counter per distinct value merges them."""
    return train.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in columns])


def apply_imputer(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fills NULL with the fitted value; filled columns become doubles."""
    values = one_row(fitted)
    numeric = {f.name: f.dataType.typeName() == "double" for f in fitted.schema.fields}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double") if numeric[c] else F.col(c), values[c])
            for c in fitted.columns
        }
    )


def fit_mode(train: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value of each column; the smallest one on a tie."""

    def mode(column: str):
        counts = (
            train.filter(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        best = F.min_by(column, F.struct(-F.col("rows"), F.col(column)))
        return counts.agg(best).scalar().alias(column)

    return train.sparkSession.range(1).select(*[mode(c) for c in columns])


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column; a zero deviation scales by 1."""
    stats = []
    for c in columns:
        value = F.col(c).cast("double")
        deviation = F.stddev_pop(value)
        stats.append(
            F.struct(
                F.avg(value).alias("mean"),
                F.when(deviation == 0, 1.0).otherwise(deviation).alias("scale"),
            ).alias(c)
        )
    return train.agg(*stats)


def apply_scaler(df: DataFrame, fitted: DataFrame) -> DataFrame:
    values = one_row(fitted)
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - values[c]["mean"]) / values[c]["scale"]
            for c in fitted.columns
        }
    )


def one_hot(columns: list[str], suffix: str = "_hot") -> list:
    """Pipeline stages: one column per known value; an unknown value is all zeros."""
    index = StringIndexer(
        inputCols=columns,
        outputCols=[f"{c}_index" for c in columns],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    encode = OneHotEncoder(
        inputCols=index.getOutputCols(),
        outputCols=[f"{c}{suffix}" for c in columns],
        dropLast=True,
    )
    return [index, encode]


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    totals = one_row(counts.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes")))
    return counts.select(
        "label", "rows", (totals["rows"] / (totals["classes"] * F.col("rows"))).alias("weight")
    )


def weigh(df: DataFrame, label: str, weights: DataFrame, column: str = "weight") -> DataFrame:
    """Adds the balanced weight of each row's class."""
    by_label = one_row(
        weights.agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("m"))
    )["m"]
    return df.withColumn(column, by_label[F.col(label)])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
