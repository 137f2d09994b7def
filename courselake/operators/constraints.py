"""Declared constraints as jobs. Spark does not enforce keys, so each one is a
query for the violating keys or rows, and ``enforce`` raises when any is found.

Key lookups aggregate the child side per key first: what is shuffled is one row
per distinct key and map task, however often a hot key repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courselake.operators.checking import Rule, violations
from courselake.schemas import (
    ASSESSMENT_TYPES,
    ATTEMPT,
    FINAL_RESULTS,
    PRESENTATION,
    RESOURCE,
    SUBMISSION,
)

# The declared keys, mandatory columns and row conditions of the core tables.
PRIMARY_KEYS = {
    "presentations": PRESENTATION,
    "assessments": ["id_assessment"],
    "resources": RESOURCE,
    "attempts": ATTEMPT,
    "submissions": SUBMISSION,
}
FOREIGN_KEYS = [
    ("assessments", "presentations", PRESENTATION),
    ("resources", "presentations", PRESENTATION),
    ("attempts", "presentations", PRESENTATION),
    ("submissions", "assessments", ["id_assessment"]),
]
MANDATORY = {
    "presentations": ["code_module", "code_presentation", "presentation_length_days"],
    "assessments": [
        "id_assessment", "code_module", "code_presentation", "assessment_type", "weight",
    ],
    "resources": ["id_site", "code_module", "code_presentation", "activity_type"],
    "attempts": [
        "code_module", "code_presentation", "id_student", "gender", "region",
        "highest_education", "age_band", "previous_attempts", "studied_credits", "disability",
        "final_result",
    ],
    "submissions": ["id_assessment", "id_student", "submitted_day", "is_banked"],
    "interactions": [
        "code_module", "code_presentation", "id_student", "id_site", "activity_day", "click_count",
    ],
}


def row_conditions() -> dict[str, dict[str, Column]]:
    """Conditions every row must not contradict; NULL does not contradict."""
    c = F.col
    return {
        "presentations": {"length_positive": c("presentation_length_days") > 0},
        "assessments": {
            "assessment_type_known": c("assessment_type").isin(ASSESSMENT_TYPES),
            "weight_in_range": c("weight").between(0, 100),
        },
        "attempts": {
            "previous_attempts_not_negative": c("previous_attempts") >= 0,
            "credits_positive": c("studied_credits") > 0,
            "disability_flag": c("disability").isin("Y", "N"),
            "final_result_known": c("final_result").isin(FINAL_RESULTS),
        },
        "submissions": {"score_in_range": c("score").between(0, 100)},
        "interactions": {"clicks_not_negative": c("click_count") >= 0},
    }


def primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unmatched(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child keys without a parent, with the number of child rows. A NULL key has none."""
    counted = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(parent.select(*keys), keys, "left_anti")


def foreign_key(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that violate a reference. Unlike ``unmatched``, a NULL key passes."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return unmatched(child.filter(known), parent, keys)


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL cells per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "rows")


def check(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Rows that contradict a condition."""
    return df.filter(~expression).withColumn("constraint_name", F.lit(name))


def check_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Contradicting rows per condition, all conditions in one pass."""
    counts = df.agg(*[F.count_if(~e).alias(n) for n, e in conditions.items()])
    return counts.unpivot([], list(conditions), "constraint_name", "rows")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def primary_key_rules() -> list[Rule]:
    return [Rule(t, "primary key", unique=tuple(keys)) for t, keys in PRIMARY_KEYS.items()]


def foreign_key_rules() -> list[Rule]:
    return [
        Rule(child, f"references {parent}", parent=parent, reference=tuple(keys), null_passes=True)
        for child, parent, keys in FOREIGN_KEYS
    ]


def not_null_rules() -> list[Rule]:
    return [
        Rule(table, f"not null {c}", lambda c=c: F.col(c).isNull())
        for table, columns in MANDATORY.items()
        for c in columns
    ]


def condition_rules() -> list[Rule]:
    return [
        Rule(table, name, lambda holds=holds: ~holds)
        for table, conditions in row_conditions().items()
        for name, holds in conditions.items()
    ]


def key_rules() -> list[Rule]:
    return [*primary_key_rules(), *foreign_key_rules()]


def row_rules() -> list[Rule]:
    return [*not_null_rules(), *condition_rules()]


def report(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, constraint_name, violations) of the rules, in as few scans as they allow."""
    return violations(rules, tables).withColumnRenamed("rule", "constraint_name")


def primary_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Duplicated keys per table."""
    return report(primary_key_rules(), tables)


def foreign_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows without a parent per declared reference."""
    return report(foreign_key_rules(), tables)


def not_null_report(tables: dict[str, DataFrame]) -> DataFrame:
    return report(not_null_rules(), tables)


def check_report(tables: dict[str, DataFrame]) -> DataFrame:
    return report(condition_rules(), tables)


def enforce(reports: list[DataFrame], counted: list[tuple[str, str, int]] = ()) -> None:
    """Raise when any report, or any (table, constraint, violations) counted before, holds a
    violation. Reads a handful of summary rows."""
    broken = [x for x in counted if x[2] > 0]
    broken += [tuple(r) for r in _union(reports).filter(F.col("violations") > 0).collect()]
    if broken:
        text = "; ".join(f"{table}: {constraint} ({n})" for table, constraint, n in broken)
        raise ValueError(f"Constraint violations: {text}")
