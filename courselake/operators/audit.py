"""Profiles of the landing tables before anything is typed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.functions.columns import one_row
from courselake.schemas import ATTEMPT, LANDING_FILES, MISSING_MARKERS, PRESENTATION


def file_profile(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and column names of each landing file."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(LANDING_FILES[name]).alias("file"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        for name, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, parts)


FINGERPRINT_MODULUS = 1 << 53


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, and the sum (modulo 2^53) and exclusive or of 52-bit hashes of the rows' text.

    The order of the rows does not matter, while a changed, swapped or repeated row does. A missing
    cell, whether NULL, blank or marked, counts as one marker.
    """
    cells = []
    for c in columns or df.columns:
        text = F.col(c).cast("string")
        cells.append(F.when(text.isNull() | text.isin(*MISSING_MARKERS), MISSING_MARKERS[-1]).otherwise(text))
    digest = F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 13)
    value = F.conv(digest, 16, 10).cast("long")
    total = F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0)) % F.lit(FINGERPRINT_MODULUS)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), total.cast("long").alias("hash_sum"),
        F.coalesce(F.bit_xor(value), F.lit(0)).alias("hash_xor"),
    )


def landed_against_expected(expected: dict[str, DataFrame], landed: dict[str, DataFrame]) -> DataFrame:
    """Per table the rows and fingerprint that were expected, those that landed, and whether they
    agree. A table that did not land has no landed figures."""
    parts = []
    for table, rows in expected.items():
        wanted = fingerprint(rows).toDF("expected_rows", "expected_sum", "expected_xor")
        if table in landed:
            found = fingerprint(landed[table], rows.columns).toDF("landed_rows", "landed_sum", "landed_xor")
        else:
            nothing = [F.lit(None).cast("long").alias(f"landed_{c}") for c in ("rows", "sum", "xor")]
            found = rows.sparkSession.range(1).select(*nothing)
        same = F.coalesce(
            (F.col("expected_rows") == F.col("landed_rows")) & (F.col("expected_sum") == F.col("landed_sum"))
            & (F.col("expected_xor") == F.col("landed_xor")),
            F.lit(False),
        )
        parts.append(
            wanted.join(found).select(  # one row each
                F.lit(LANDING_FILES[table]).alias("file"), "*", same.alias("agrees")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def missing_cells(df: DataFrame, markers: tuple[str, ...] = MISSING_MARKERS) -> DataFrame:
    """Missing cells per column in one pass; columns without any are left out.

    A blank field reads back from a landing file as NULL, so NULL is missing too.
    """
    counts = df.agg(
        *[
            F.count_if(F.col(c).isNull() | F.col(c).cast("string").isin(*markers)).alias(c)
            for c in df.columns
        ]
    )
    return counts.unpivot([], df.columns, "column_name", "missing").filter(F.col("missing") > 0)


def missing_report(raw: dict[str, DataFrame]) -> DataFrame:
    parts = [
        missing_cells(df).select(F.lit(LANDING_FILES[name]).alias("file"), "column_name", "missing")
        for name, df in raw.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _distinct(df: DataFrame, *columns: str):
    """Distinct non-null values, or distinct tuples, of the columns."""
    value = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return df.agg(F.count_distinct(value)).scalar()


def calculated_scale(raw: dict[str, DataFrame]) -> DataFrame:
    """One row of totals. Each figure is a scalar subquery over one table; every table is counted
    once."""
    spark = raw["courses"].sparkSession
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name)) for name, df in raw.items()],
    )
    activity = F.max(F.when(F.col("name") == "student_vle", F.col("rows")))
    total = one_row(counts.agg(F.sum("rows").alias("all"), activity.alias("activity")))
    return spark.range(1).select(
        total["all"].alias("csv_rows"),
        _distinct(raw["student_info"], "id_student").alias("unique_students"),
        _distinct(raw["student_info"], *ATTEMPT).alias("student_module_attempts"),
        _distinct(raw["courses"], "code_module").alias("modules"),
        _distinct(raw["courses"], *PRESENTATION).alias("module_presentations"),
        _distinct(raw["assessments"], "id_assessment").alias("assessments"),
        total["activity"].alias("activity_records"),
    )


def anomalies(raw: dict[str, DataFrame]) -> DataFrame:
    """One row: repeated attempt keys beyond the first, and missing cells of note. Each table is
    scanned once; missing cells of a table with attempts ride on its grouping by attempt."""
    spark = raw["student_info"].sparkSession

    def gone(column: str):
        return F.count_if(F.col(column).isNull() | F.col(column).isin(*MISSING_MARKERS))

    def by_attempt(table: str, column: str):
        keyed = raw[table].groupBy(*ATTEMPT).agg(F.count(F.lit(1)).alias("rows"), gone(column).alias("gone"))
        return one_row(
            keyed.agg(
                F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("repeats"),
                F.coalesce(F.sum("gone"), F.lit(0)).alias("gone"),
            )
        )

    info = by_attempt("student_info", "imd_band")
    registration = by_attempt("student_registration", "date_unregistration")
    return spark.range(1).select(
        info["repeats"].alias("student_attempt_duplicates"),
        registration["repeats"].alias("registration_attempt_duplicates"),
        info["gone"].alias("missing_imd_band"),
        raw["assessments"].agg(gone("date")).scalar().alias("missing_assessment_due_dates"),
        registration["gone"].alias("missing_unregistration_dates"),
    )


def narrow_profile(profile: DataFrame, digests: DataFrame) -> DataFrame:
    """The file profile without its name list, with size and digest of each file.

    A file that landed in several parts has a digest per part and none as a whole.
    """
    parts = F.count(F.lit(1))
    sizes = digests.groupBy("file").agg(
        parts.alias("parts"),
        F.sum("length").alias("bytes"),
        F.when(parts == 1, F.max("sha256")).alias("sha256"),
    )
    return profile.select("file", "rows", "columns").join(sizes, "file", "left")
