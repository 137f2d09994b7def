"""Maps the driver's star schema onto the seven course-activity relations.

The mapping uses modular arithmetic only, so any engine derives the same rows.
Every relation is lazy, reads only the columns it needs and is built with joins
and aggregations that combine before the shuffle. No side is broadcast by hint:
Catalyst broadcasts a side only when its known size is below the session's
threshold, and AQE splits a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.schemas import ATTEMPT, LANDING_COLUMNS, PRESENTATION, RESOURCE

EPOCH = "1995-01-01"
# Names the adapter gives to site kinds and age groups.
ACTIVITY_TYPES = ["forumng", "homepage", "oucontent", "quiz", "resource"]
AGE_BANDS = ["0-35", "35-55", "55<="]
# Weights of the seven assessments of a presentation.
WEIGHTS = [10, 15, 20, 15, 20, 20, 100]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _days(stamp: str) -> Column:
    return F.datediff(F.col(stamp).cast("date"), F.lit(EPOCH).cast("date"))


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _region_key() -> Column:
    return F.ascii("code_module") - F.lit(ord("A"))


def _year() -> Column:
    return F.substring("code_presentation", 1, 4).cast("int")


def _half() -> Column:
    return F.when(F.substring("code_presentation", 5, 1) == "J", 1).otherwise(0)


def enrolled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the presentation and student they stand for."""
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    year = 2013 + (F.year("o_orderdate") - 1995) % 2
    term = F.when(F.month("o_orderdate") <= 6, "B").otherwise("J")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.repeat(F.char(F.lit(ord("A")) + F.col("n_regionkey")), F.lit(3)).alias("code_module"),
        F.concat(year.cast("string"), term).alias("code_presentation"),
        F.col("o_custkey").cast("int").alias("id_student"),
        "n_name",
        "c_mktsegment",
        _days("o_orderdate").alias("order_day"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = 234 + 9 * _region_key() - F.when(_region_key() == 4, 200).otherwise(0)
    return (
        enrolled_orders(spark, sf_dir)
        .select(*PRESENTATION)
        .distinct()
        .withColumn("presentation_length_days", length.cast("int"))
    )


def _outcome_digit() -> Column:
    return (F.col("id_student").cast("long") * 7 + 2 * _year() + _half()) % 10


def _final_result() -> Column:
    r = _outcome_digit()
    return (
        F.when(r == 0, "Distinction").when(r <= 4, "Pass").when(r <= 6, "Fail").otherwise("Withdrawn")
    )


def student_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    student = F.col("id_student").cast("long")
    decile = 10 * (student % 10)
    band = F.concat(decile.cast("string"), F.lit("-"), (decile + 10).cast("string"), F.lit("%"))
    return (
        enrolled_orders(spark, sf_dir)
        .select(
            *ATTEMPT,
            F.col("n_name").alias("region"),
            F.col("c_mktsegment").alias("highest_education"),
        )
        .distinct()
        .select(
            *ATTEMPT,
            F.when(student % 2 == 0, "F").otherwise("M").alias("gender"),
            "region",
            "highest_education",
            F.when(student % 29 != 0, band).alias("imd_band"),
            _pick(AGE_BANDS, student % 3).alias("age_band"),
            (student % 4).cast("int").alias("previous_attempts"),
            (30 * (1 + student % 4)).cast("int").alias("studied_credits"),
            F.when(student % 10 == 0, "Y").otherwise("N").alias("disability"),
            _final_result().alias("final_result"),
        )
    )


def student_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    student = F.col("id_student")
    leaves = (_outcome_digit() >= 7) & (student % 11 != 0)
    return (
        enrolled_orders(spark, sf_dir)
        .groupBy(*ATTEMPT)
        .agg(
            F.min(F.col("order_day") % 60).alias("first_day"),
            F.max("order_day").alias("last_day"),
        )
        .select(
            *ATTEMPT,
            F.when(student % 97 != 0, F.col("first_day") - 50).cast("int").alias("registration_day"),
            F.when(leaves, 10 + F.col("last_day") % 120).cast("int").alias("unregistration_day"),
        )
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % 100).cast("int").alias("id_site"),
        (_days("l_shipdate") % 140 - 14).cast("int").alias("activity_day"),
        F.col("l_quantity").cast("int").alias("click_count"),
    )
    enrolled = enrolled_orders(spark, sf_dir).select("o_orderkey", *ATTEMPT)
    return lines.join(enrolled, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *ATTEMPT, "id_site", "activity_day", "click_count"
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        interactions(spark, sf_dir)
        .select(*RESOURCE)
        .distinct()
        .select(
            *RESOURCE,
            _pick(ACTIVITY_TYPES, F.col("id_site") % 5).alias("activity_type"),
            F.lit(None).cast("int").alias("week_from"),
            F.lit(None).cast("int").alias("week_to"),
        )
    )


def _assessment_id(number: Column) -> Column:
    return (((_year() - 2013) * 2 + _half()) * 100 + 10 * _region_key() + number).cast("int")


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("number")
    return (
        courses(spark, sf_dir)
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(7))))
        .select(
            _assessment_id(number).alias("id_assessment"),
            *PRESENTATION,
            F.when(number == 7, "Exam")
            .when(number % 2 == 1, "TMA")
            .otherwise("CMA")
            .alias("assessment_type"),
            F.when(number < 7, 20 * number).cast("int").alias("due_day"),
            _pick(WEIGHTS, number - 1).cast("decimal(6,2)").alias("weight"),
        )
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments 1 to 6 follow from the attempt itself, so no join is needed."""
    student = F.col("id_student").cast("long")
    task = F.col("id_assessment").cast("long")
    score = F.when((student + task) % 53 != 0, (student * 13 + task * 29) % 101)
    return (
        enrolled_orders(spark, sf_dir)
        .select(*ATTEMPT)
        .distinct()
        .withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(6))))
        .withColumn("id_assessment", _assessment_id(F.col("number")))
        .filter((student * 31 + task * 17) % 100 < 70)
        .select(
            "id_assessment",
            "id_student",
            (20 * F.col("number") + (student + task) % 9 - 5).cast("int").alias("submitted_day"),
            ((student + task) % 67 == 0).alias("is_banked"),
            score.cast("decimal(5,2)").alias("score"),
        )
    )


def _landing(df: DataFrame, table: str, sources: dict[str, Column | str]) -> DataFrame:
    """Text rows as a landing file holds them: a missing value is written '?'."""
    out = []
    for name in LANDING_COLUMNS[table]:
        value = sources.get(name, name)
        value = F.col(value) if isinstance(value, str) else value
        out.append(F.coalesce(value.cast("string"), F.lit("?")).alias(name))
    return df.select(*out)


def landing_form(df: DataFrame, table: str) -> DataFrame:
    """A relation as its landing file holds it, with the padding that staging must trim."""

    def padded(name: str) -> Column:
        return F.concat(F.lit(" "), F.col(name), F.lit(" "))

    # Landing names of the columns that staging renames.
    sources: dict[str, dict[str, Column | str]] = {
        "courses": {"module_presentation_length": "presentation_length_days"},
        "assessments": {"date": "due_day", "assessment_type": padded("assessment_type")},
        "vle": {"activity_type": padded("activity_type")},
        "student_info": {"num_of_prev_attempts": "previous_attempts", "region": padded("region")},
        "student_registration": {
            "date_registration": "registration_day",
            "date_unregistration": "unregistration_day",
        },
        "student_assessment": {
            "date_submitted": "submitted_day",
            "is_banked": F.col("is_banked").cast("int"),
        },
    }
    if table == "student_vle":
        return df.select(
            *ATTEMPT,
            "id_site",
            F.col("activity_day").alias("date"),
            F.col("click_count").alias("sum_click"),
        )
    return _landing(df, table, sources[table])
