"""The relations and marts of one source folder, as the registered queries see them.

Relations and marts are stored once per application when a query first needs them, as
the layers of a pipeline are. A query then reads columns of stored tables, joins sides
whose size Catalyst knows, and a lost executor costs a re-read and not a re-derivation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.operators import core, features, marts
from courselake.operators.models import model_frame
from courselake.schemas import ASSESSMENT_TARGET
from courselake.sources import adapter
from courselake.sources.shelf import Shelf


RELATIONS = {
    "courses": adapter.courses,
    "assessments": adapter.assessments,
    "vle": adapter.resources,
    "student_info": adapter.student_info,
    "student_registration": adapter.student_registration,
    "student_assessment": adapter.submissions,
    "student_vle": adapter.interactions,
}


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    @cached_property
    def shelf(self) -> Shelf:
        return Shelf(self.spark, self.sf_dir)

    def relation(self, table: str) -> DataFrame:
        return self.shelf.table(table, lambda: RELATIONS[table](self.spark, self.sf_dir))

    def landing(self, table: str) -> DataFrame:
        return adapter.landing_form(self.relation(table), table)

    def all_landing(self) -> dict[str, DataFrame]:
        return {table: self.landing(table) for table in RELATIONS}

    @property
    def courses(self) -> DataFrame:
        return self.relation("courses")

    @property
    def assessments(self) -> DataFrame:
        return self.relation("assessments")

    @property
    def resources(self) -> DataFrame:
        return self.relation("vle")

    @property
    def info(self) -> DataFrame:
        return self.relation("student_info")

    @property
    def registration(self) -> DataFrame:
        return self.relation("student_registration")

    @property
    def submissions(self) -> DataFrame:
        return self.relation("student_assessment")

    @property
    def interactions(self) -> DataFrame:
        return self.relation("student_vle")

    @property
    def attempts(self) -> DataFrame:
        return self.shelf.table(
            "attempts", lambda: core.student_attempts(self.info, self.registration)
        )

    def build_weekly(self) -> DataFrame:
        return marts.weekly_engagement(self.interactions)

    def build_progress(self) -> DataFrame:
        return marts.assessment_progress(self.attempts, self.assessments, self.submissions)

    def build_snapshots(self, missing_rule: str = "reference") -> DataFrame:
        return features.model_snapshots(
            self.attempts, self.courses, self.weekly, self.progress, missing_rule=missing_rule
        )

    @property
    def weekly(self) -> DataFrame:
        return self.shelf.table("weekly", self.build_weekly)

    @property
    def progress(self) -> DataFrame:
        return self.shelf.table("progress", self.build_progress)

    @property
    def snapshots(self) -> DataFrame:
        return self.shelf.table("snapshots", self.build_snapshots)

    @property
    def aligned(self) -> DataFrame:
        return marts.withdrawal_aligned(self.attempts, self.weekly)

    @property
    def spine(self) -> DataFrame:
        return features.attempt_weeks(self.attempts, self.courses)

    def core_tables(self) -> dict[str, DataFrame]:
        """The six core relations and the two staging relations they come from."""
        return {
            "presentations": self.courses,
            "assessments": self.assessments,
            "resources": self.resources,
            "student_info": self.info,
            "registration": self.registration,
            "submissions": self.submissions,
            "interactions": self.interactions,
        }

    def split(self, name: str | None = None) -> DataFrame:
        """Model rows with their split, or the rows of one split."""
        rows = features.temporal_split(model_frame(self.snapshots))
        return rows if name is None else rows.filter(F.col("split") == name).drop("split")

    @property
    def scored(self) -> DataFrame:
        """Snapshots with an arithmetic score, so any engine can evaluate the same numbers."""
        number = F.col("id_student").cast("long") * 37 + F.col("course_week") * 101
        return features.temporal_split(self.snapshots).select(
            "*",
            F.lit("arithmetic").alias("model"),
            (F.pmod(number, F.lit(1000)) / F.lit(1000.0)).alias("probability"),
            F.col(ASSESSMENT_TARGET).alias("y"),
        )
