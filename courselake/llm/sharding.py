"""Histogram sort: documents into shards of near equal bytes, by splitters found from counts.

The sort key of a document is 56 bits of its text's digest, then 56 bits of its id's. Bytes
are counted exactly per key interval; an interval that holds a splitter is counted again in
256 parts until the splitter's nearest boundary is within tolerance. Then the rows are
exchanged once, by shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courselake.llm.common import stored

BITS = 56
STEP = 8


def digest(column: Column) -> Column:
    """56 bits of the text's MD5, as a long from 0."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 14), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its size and sort key. A null text counts as empty, a null id as ''."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "_size": F.octet_length(text).cast("long") + 8,
            "_key": digest(text),
            "_tie": digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        }
    )


@dataclass(frozen=True)
class Splitter:
    """Rows at or above (key, tie) are on its upper side; ``below`` bytes lie under it."""

    key: int
    tie: int
    below: int


def _histogram(rows: DataFrame, column: str, parents: list[tuple[int, int]], shift: int) -> dict:
    """(bytes, rows) per interval of width 2**shift, inside the given (key, prefix) parents."""
    part = F.shiftright(F.col(column), shift)
    inside = None
    for fixed, prefix in parents:
        here = F.shiftright(F.col(column), shift + STEP) == prefix
        if column == "_tie":
            here = here & (F.col("_key") == fixed)
        inside = here if inside is None else inside | here
    fixed = F.col("_key") if column == "_tie" else F.lit(0)
    counted = (
        rows.where(inside)
        .groupBy(fixed.alias("fixed"), part.alias("part"))
        .agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
    )
    return {(r["fixed"], r["part"]): (r["bytes"], r["rows"]) for r in counted.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """``shards - 1`` boundaries in key order, each within ``tolerance`` of a shard's mean
    bytes of its target, or at the nearest document where a document is larger than that.

    Per round the driver gets at most 256 sums for each splitter that is still open.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return [Splitter(0, 0, 0)] * (shards - 1)
    slack = tolerance * total / shards
    found: dict[int, Splitter] = {}
    # open splitter -> (column, fixed key, prefix, bytes below the interval)
    open_at = {i: ("_key", 0, 0, 0) for i in range(1, shards)}
    key_shift = tie_shift = BITS
    while open_at:
        for column in ("_key", "_tie"):
            here = {i: at for i, at in open_at.items() if at[0] == column}
            if not here:
                continue
            if column == "_key":
                shift = key_shift = max(key_shift - STEP, 0)
            else:
                shift = tie_shift = max(tie_shift - STEP, 0)
            parents = sorted({(fixed, prefix) for _, fixed, prefix, _ in here.values()})
            sums = _histogram(rows, column, parents, shift)
            for i, (_, fixed, prefix, below) in here.items():
                target = total * i / shards
                part = prefix << STEP
                last = part + (1 << STEP) - 1
                here_bytes = lambda: sums.get((fixed, part), (0, 0))[0]  # noqa: E731, B023
                while part < last and below + here_bytes() < target:
                    below += here_bytes()
                    part += 1
                above = below + here_bytes()
                alone = sums.get((fixed, part), (0, 0))[1] <= 1
                low, high = part << shift, (part + 1) << shift
                near, at, under = min((abs(below - target), low, below), (abs(above - target), high, above))
                if near <= slack or alone or (column == "_tie" and shift == 0):
                    key, tie = (at, 0) if column == "_key" else (fixed, at)
                    found[i] = Splitter(key, tie, under)
                    del open_at[i]
                elif shift == 0:
                    open_at[i] = ("_tie", low, 0, below)
                else:
                    open_at[i] = (column, fixed, part, below)
    return sorted(found.values(), key=lambda s: (s.key, s.tie))


def shard_of(cuts: list[Splitter]) -> Column:
    """How many boundaries lie at or below the row's key."""
    reached = [
        (F.col("_key") > s.key) | ((F.col("_key") == s.key) & (F.col("_tie") >= s.tie)) for s in cuts
    ]
    return sum((r.cast("int") for r in reached), F.lit(0)).cast("int")


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """``docs`` with shard (from 0), slot (gapless from 0 in its shard) and bytes.

    All documents are kept, with their columns; a null text has no bytes, so it weighs 8.
    Equal texts have one key: they stay in one shard, unless they alone exceed the tolerance;
    then the splitter falls between their ids. Rows equal in text and id may not be told apart,
    which leaves their slots, not the result's rows, open. An empty table gives no rows. Existing
    columns named shard, slot or bytes are replaced. Slots are numbered from counts per
    (shard, lane), 64 lanes each, so no task numbers a whole shard.
    """
    keys = stored(keyed(docs).select("_size", "_key", "_tie"))
    cuts = splitters(keys, shards, tolerance)
    lane = F.shiftright(F.col("_tie"), BITS - 6)
    placed = (
        keyed(docs.drop("shard", "slot", "bytes"))
        .withColumn("shard", shard_of(cuts))
        .withColumn("_lane", lane)
    )
    lanes = keys.groupBy(shard_of(cuts).alias("shard"), lane.alias("_lane")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = lanes.select("shard", "_lane", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_lane").orderBy("_key", "_tie", "_size")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(starts, ["shard", "_lane"])
        .withColumn("slot", F.col("_start") + F.col("_at") - 1)
        .withColumnRenamed("_size", "bytes")
        .drop("_key", "_tie", "_lane", "_at", "_start")
    )
