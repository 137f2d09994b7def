"""The core model: attempts joined from information and registration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.schemas import ATTEMPT


def student_attempts(info: DataFrame, registration: DataFrame) -> DataFrame:
    """One row per attempt; the registration days are NULL when no row matches."""
    return info.join(
        registration.select(*ATTEMPT, "registration_day", "unregistration_day"), ATTEMPT, "left"
    ).select(
        *ATTEMPT,
        "gender",
        "region",
        "highest_education",
        "imd_band",
        "age_band",
        "previous_attempts",
        "studied_credits",
        "disability",
        "final_result",
        "registration_day",
        "unregistration_day",
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
