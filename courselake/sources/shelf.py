"""Tables written once per application to the shared folder and read back.

A mart that several queries read is written as parquet and reopened from there.
That cuts its lineage, survives a lost executor, keeps column pruning and
statistics, and lets Catalyst know the size of every stored side. The folder is
the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.session import raise_shuffles

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_WRITTEN: dict[tuple[str, str, str], str] = {}
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. A local one is made only for a local master."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="courselake-")
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/courselake/{app}/{name}-{uuid.uuid4().hex[:12]}"


def folder_size(spark: SparkSession, folder: str):
    """Row of file count, bytes and newest change below a folder, from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").cast("double").alias("changed"),
        )
        .first()
    )


def fingerprint(folder: str, row) -> str:
    """Text that changes when the files below a folder do, whose size is ``row``."""
    return f"{folder}|{row.files}|{row.bytes}|{row.changed}"


class Shelf:
    """The stored tables and models that belong to one state of one source folder.

    Opening one sizes the session's shuffles for the folder, so that a task's rows do not grow with it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        size = folder_size(spark, folder)
        raise_shuffles(spark, size.bytes or 0)
        self.key = fingerprint(folder, size)
        self.app = spark.sparkContext.applicationId

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: list[str] | None = None,
    ) -> DataFrame:
        """The stored table, written first if this application has not done so."""
        key = (self.app, self.key, name)
        if key not in _WRITTEN:
            path = new_path(self.spark, name)
            writer = build().write
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The stored pipeline, fitted and saved first if needed."""
        key = (self.app, self.key, f"model:{name}")
        if key not in _WRITTEN:
            path = new_path(self.spark, f"model-{name}")
            fit().write().save(path)
            _WRITTEN[key] = path
        return PipelineModel.load(_WRITTEN[key])
