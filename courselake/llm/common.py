"""Helpers the operators share: reading tables, stored results, words, Arrow batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark: SparkSession) -> None:
    """From here on a query's shuffle files go when it ends, unless the session says otherwise; Spark
    keeps them until the driver happens to collect its garbage, and several steps' files add up."""
    if spark.conf.get(CLEANUP_SETTING, None) is None:
        spark.conf.set(CLEANUP_SETTING, "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    free_shuffles(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back; cuts the lineage."""
    spark = df.sparkSession
    free_shuffles(spark)
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of bounded bytes, so that Python tasks hold a few long texts at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` inside tasks; it is broadcast once, with its classes."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    kept: list = []

    def get():
        if not kept:
            kept.append(pickle.loads(packed.value))
        return kept[0]

    return get


def learns(doc_id: Column, modulus: int, left_out: int) -> Column:
    """False for rows whose crc32 of the id's text falls on ``left_out``; a null id learns."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != left_out, F.lit(True))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# A random value per byte (none for white space) and an odd one per place in a word.
_BYTES = np.where(SPACE, np.uint64(0), scramble(np.arange(1, 257, dtype=np.uint64)))
_PLACES = scramble(np.arange(1000, 1512, dtype=np.uint64)) | np.uint64(1)
SLICE = 1 << 20


def slices(data: bytes) -> Iterator[tuple[int, int]]:
    """The text in parts of about SLICE bytes that end after white space or with the text."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not SPACE[data[end - 1]]:
            end += 1
        yield at, end
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the text's words, runs without ASCII white space, in order."""
    found = []
    for at, end in slices(data):
        b = np.frombuffer(data, np.uint8, end - at, at)
        space = SPACE[b]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        if not len(starts):
            continue
        b = b[starts[0] :]
        starts = starts - starts[0]
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
        if len(b) > len(_PLACES) and place.max() >= len(_PLACES):
            factor = scramble(place.astype(np.uint64) + np.uint64(1000)) | np.uint64(1)
        else:
            factor = _PLACES[np.minimum(place, len(_PLACES) - 1)]
        found.append(np.add.reduceat(_BYTES[b] * factor, starts))
    return scramble(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch, one at a time; empty for null."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges and the smallest node that each is connected with."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while (parent[x] != parent[y]).any():
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _contracted(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The edges with what each task holds, ``most`` at a time, replaced by (node, smallest node)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(some: list) -> pa.RecordBatch:
            node, root = roots(*(np.concatenate(c) for c in zip(*some)))
            child = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(root[child])], ["a", "b"])

        some, n = [], 0
        for batch in batches:
            some.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield stars(some)
                some, n = [], 0
        if some:
            yield stars(some)

    return map_arrow(edges.select("a", "b"), contract, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, from edges (a, b) of longs.

    Tasks contract the edges they hold; large-star and small-star steps in turn connect what lies
    in several tasks. Each round is stored, and the loop ends when the edges are stars: no centre
    has a centre of its own and no node has two.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        linked = both.join(least, "a")
        if large:
            linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return linked.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("centre")).union(
            e.select("b", F.lit(0), F.lit(1))
        )
        facts = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
        return facts.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("centre") > 0))).isEmpty()

    edges = stored(_contracted(edges.where("a <> b").select("a", "b").distinct()))
    while not settled(edges):
        edges = stored(_contracted(stars(stars(edges, True), False)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
