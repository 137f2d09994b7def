"""Small column expressions used across the layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_of(day: Column | str) -> Column:
    """Course week of a relative day. Floors, so day -1 is in week -1."""
    day = F.col(day) if isinstance(day, str) else day
    return F.floor(day / F.lit(7)).cast("int")


def last_day_of(week: Column | str) -> Column:
    """Last relative day of a course week."""
    week = F.col(week) if isinstance(week, str) else week
    return (week * 7 + 6).cast("int")


def exact_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """numerator / denominator rounded half up in decimal arithmetic; NULL on 0.

    ``avg`` of a decimal keeps too few digits and ``avg`` of an integer is a
    double, so means that get rounded go through sum / count in wide decimals.
    """
    wide = numerator.cast("decimal(24,4)") / F.nullif(denominator.cast("decimal(18,0)"), F.lit(0))
    return F.round(wide, places)


def exact_mean(value: str, places: int) -> Column:
    """Aggregate: rounded mean of the non-null values of a column."""
    return exact_ratio(F.sum(value), F.count(value), places)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def nulls_last(*names: str) -> list[Column]:
    """Ascending order with NULL at the end."""
    return [F.col(n).asc_nulls_last() for n in names]


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct column, read as a scalar subquery.

    Spark evaluates the subquery once, so fitted statistics reach a large frame
    without a join.
    """
    return stats.select(F.struct(*stats.columns)).scalar()


def doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles, other columns unchanged."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
