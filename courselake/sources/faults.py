"""Copies of the relations with faults placed by arithmetic on the keys.

Used to show that every constraint and check reports exactly the rows broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _every(n: int, *columns: str) -> Column:
    total = sum((F.col(c).cast("long") for c in columns), F.lit(0))
    return total % n == 0


def _break(df: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)).cast(kind))


def faulty(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drops parents, repeats keys, blanks mandatory cells and breaks value ranges."""
    t = dict(tables)
    lost = (F.col("code_module") == "DDD") & (F.col("code_presentation") == "2014J")
    kept = t["presentations"].filter(~lost)
    kept = _break(kept, "presentation_length_days", F.col("code_module") == "AAA", F.lit(0))
    t["presentations"] = _break(
        kept,
        "code_presentation",
        (F.col("code_module") == "CCC") & (F.col("code_presentation") == "2013B"),
        F.lit("2015B"),
    )
    t["resources"] = t["resources"].filter(~_every(17, "id_site"))

    info = t["student_info"].filter(~_every(19, "id_student"))
    info = info.unionByName(info.filter(_every(23, "id_student")))
    info = _break(info, "final_result", _every(31, "id_student"), F.lit("Other"))
    info = _break(info, "gender", _every(37, "id_student"), F.lit(None))
    t["student_info"] = _break(info, "studied_credits", _every(41, "id_student"), F.lit(0))

    t["registration"] = _break(
        t["registration"],
        "unregistration_day",
        _every(13, "id_student"),
        F.col("registration_day") - 1,
    )
    t["assessments"] = _break(
        t["assessments"], "weight", F.col("id_assessment") % 10 == 3, F.lit(120)
    )
    handed = t["submissions"]
    handed = handed.unionByName(handed.filter(_every(71, "id_assessment", "id_student")))
    t["submissions"] = _break(
        handed, "score", _every(59, "id_assessment", "id_student"), F.lit(150)
    )
    t["interactions"] = _break(
        t["interactions"], "click_count", _every(29, "id_site"), -F.col("click_count")
    )
    return t


def with_bad_cells(raw_submissions: DataFrame) -> DataFrame:
    """Landing submissions with cells that cannot be cast."""
    broken = _break(raw_submissions, "score", _every(41, "id_assessment", "id_student"),
                    F.lit("absent"))
    return _break(broken, "date_submitted", _every(43, "id_assessment", "id_student"),
                  F.lit("day ten"))


def malformed_lines(raw: DataFrame) -> DataFrame:
    """Landing lines as text, one column named by the header; some have a field more or less."""
    columns = raw.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]
    number = sum((F.col(c).cast("long") for c in ("id_assessment", "id_student")), F.lit(0))
    line = (
        F.when(number % 37 == 0, F.concat_ws(",", *cells, F.lit("more")))
        .when(number % 47 == 0, F.concat_ws(",", *cells[:-1]))
        .otherwise(F.concat_ws(",", *cells))
    )
    return raw.select(line.alias(",".join(columns)))
