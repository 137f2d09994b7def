"""Landing files: read as they are, listed, and digested."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.schemas import LANDING_FILES, landing_schema


def land_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A landing file as declared: text columns, header checked, bad rows stop the job.

    A blank field reads as NULL and a '?' stays '?', so profiling sees both.
    """
    return (
        spark.read.schema(landing_schema(table))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("mode", "FAILFAST")
        .option("encoding", "UTF-8")
        .csv(path)
    )


def land_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All seven landing tables of a folder."""
    return {
        table: land_csv(spark, f"{folder.rstrip('/')}/{name}", table)
        for table, name in LANDING_FILES.items()
    }


def land_or_reject(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(landed rows, rejected lines) of a landing file; a malformed line does not stop the job.

    A line with too few or too many fields, or a cell that its declared type can't hold, is kept
    whole with file, number of fields and what could be read of it. The header is still checked.
    """
    names = spark.createDataFrame([], landing_schema(table)).columns
    rows = (
        spark.read.schema(f"{landing_schema(table)}, _line string")
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .option("columnPruning", "false")  # a line is judged by all its fields
        .option("encoding", "UTF-8")
        .csv(path)
        .select("*", F.col("_metadata.file_name").alias("_file"))
    )
    outside = F.regexp_replace("_line", '"[^"]*"', "")
    fields = F.regexp_count(outside, F.lit(",")) + 1
    reason = (
        F.when(fields < len(names), "too few fields").when(fields > len(names), "too many fields")
        .otherwise("unreadable cell")
    )
    # always true; Spark refuses to read the line alone, as in a count of the rejected ones
    read = F.length(F.coalesce(F.col(names[0]).cast("string"), F.lit(""))) >= 0
    landed = rows.filter(F.col("_line").isNull() & read).select(*names)
    rejected = rows.filter(F.col("_line").isNotNull() & read).select(
        *names, F.col("_line").alias("line"), F.col("_file").alias("file"),
        fields.cast("int").alias("fields"), reason.alias("reason"),
    )
    return landed, rejected


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder, by path inside it and by entry of the folder.

    An entry is a file, or a folder of part files that together are one. Contents
    are read only when selected.
    """
    root = re.sub(_SCHEME, "", folder).rstrip("/")
    inside = F.substr(F.regexp_replace("path", _SCHEME, ""), F.lit(len(root) + 2))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .withColumn("part", inside)
        .withColumn("file", F.substring_index("part", "/", 1))
    )


def missing_files(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """Expected names that the folder does not hold, as a file or as a folder of parts."""
    present = _listing(spark, folder).select("file").distinct()
    wanted = spark.createDataFrame([(name,) for name in sorted(set(expected))], "file string")
    return wanted.join(present, "file", "left_anti")


def require_files(spark: SparkSession, folder: str, expected: list[str]) -> None:
    absent = sorted(r.file for r in missing_files(spark, folder, expected).collect())
    if absent:
        raise FileNotFoundError(f"Missing from {folder}: {absent}")


BLOCK = 8 << 20


def _digests_in_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each path, read in blocks, so that a task holds one block."""
    for frame in frames:
        sums = []
        for path in frame["path"]:
            if path.startswith("file:"):
                system, inside = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, inside = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inside) as stream:
                while block := stream.read(BLOCK):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield frame.drop(columns="path").assign(sha256=sums)


def file_digests(spark: SparkSession, folder: str, whole_up_to: int = 256 << 20) -> DataFrame:
    """SHA-256 of every file below a folder. A digest is sequential, so a task takes whole files.

    Files up to ``whole_up_to`` bytes are digested by the binary source, which holds a file in
    one row; larger ones are read in blocks. The size condition reaches the source, so neither
    side reads the other's files.
    """
    listing = _listing(spark, folder)
    columns = ["file", "part", "length"]
    small = listing.filter(F.col("length") <= whole_up_to).select(
        *columns, F.sha2("content", 256).alias("sha256")
    )
    large = (
        listing.filter(F.col("length") > whole_up_to)
        .select("path", *columns)
        .mapInPandas(_digests_in_blocks, "file string, part string, length long, sha256 string")
    )
    return small.unionByName(large)


def compare_digests(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest differs from the expected one, or that are absent."""
    actual = digests.select("part", F.col("sha256").alias("actual"))
    return (
        expected.select("part", F.col("sha256").alias("expected"))
        .join(actual, "part", "left")
        .filter(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def require_digests(digests: DataFrame, expected: DataFrame) -> None:
    differing = sorted(r.part for r in compare_digests(digests, expected).collect())
    if differing:
        raise ValueError(f"Files absent or with another digest: {differing}")
