"""Time-varying curriculum: sources mixed to target weights, documents ordered by position.

Every source has a weight schedule over training time 0 to 1, piecewise linear. Its integral
is the source's weight; the weights share the corpus's words under a cap. A source's documents
follow each other in a fixed random order, pass after pass, until its target is met; where its
cumulative demand reaches a document is the document's training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courselake.llm.common import WORD, stored

# (time, weight) knots by slot; sources take the slots in turn. The integrals are 5, 2 and 1.
SCHEDULES = (
    ((0.0, 7.0), (1.0, 3.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _by_slot(slot: Column, values: list) -> Column:
    out = F.lit(None)
    for i, value in enumerate(values):
        out = F.when(slot == i, value).otherwise(out)
    return out


def demand_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral is spent."""
    whole, spent = integral(knots), 0.0
    out = F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        slope = (w1 - w0) / (t1 - t0)
        pieces.append((spent, t0, w0, slope))
        spent += (t1 - t0) * (w0 + w1) / 2
    for start, t0, w0, slope in pieces:
        rest = share * whole - start
        # root of w0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes
        root = 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
        out = F.when(rest >= 0, F.least(F.lit(1.0), t0 + root)).otherwise(out) if start else F.least(F.lit(1.0), t0 + root)
    return out


def targets(sizes: DataFrame, schedules=SCHEDULES, cap: float = 3.0) -> DataFrame:
    """(source, slot, source_size, target) from (source, source_size), one row per source.

    Weights go round by the source's place in code point order, null last. Sharing the excess
    again and again ends where every open source has the same target per weight and the
    others their cap; that level is found by running sums over the sources in the order in
    which they reach their caps. The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = _by_slot(F.col("slot"), [F.lit(integral(k)) for k in schedules])
    ranked = (
        sizes.withColumn("slot", ((F.row_number().over(order) - 1) % len(schedules)).cast("int"))
        .withColumn("weight", weight)
        .withColumn("most", cap * F.col("source_size"))
    )
    whole = Window.partitionBy()
    capped = (
        Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    level = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("used", F.coalesce(F.sum("most").over(capped), F.lit(0.0)))
        .withColumn(
            "open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(capped), F.lit(0.0))
        )
        .withColumn("level", (F.col("total") - F.col("used")) / F.nullif(F.col("open"), F.lit(0.0)))
    )
    # the first source whose cap is not reached at its level fixes the level of all later ones
    over = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("used", "level"))
    return (
        level.withColumn("last", F.min(over).over(whole)["level"])
        .withColumn(
            "target",
            F.coalesce(F.least(F.col("most"), F.col("last") * F.col("weight")), F.col("most")),
        )
        .select("source", "slot", F.col("source_size").cast("long"), "target")
    )


def curriculum(docs: DataFrame, schedules=SCHEDULES, cap: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, source_size, target, copies, taken, position.

    A document is taken whole: once for every full pass over its source, and once more if the
    rest of the target covers its middle; so a source ends within half a document of its
    target. A null text has size 0 and is taken as often as the pass reaches it; an empty
    table gives no rows. Repeated rows count as documents of their own; ties in the order are
    broken by id, size and ``keep``, so reruns agree. Only doc_id, source, text and the columns of
    ``keep`` are read, and these reach the result; other columns of ``docs``, also those with the
    names above, do not. ``position`` is the time of the first copy, null if there is none.

    The prefix sums run per (source, bucket) with bucket totals as offsets; the bucket count
    grows with the rows, so a hot source is spread over many tasks.
    """
    names = ("size", "source_size", "target", "copies", "taken", "position")
    sized = docs.drop(*names).withColumn(
        "size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    )
    lean = stored(
        sized.select(
            "doc_id", "source", "size",
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"), *keep,
        )
    )
    return _planned(lean, schedules, cap, keep)


def _planned(lean: DataFrame, schedules, cap: float, keep: tuple[str, ...]) -> DataFrame:
    digits = 1
    rows = lean.count()
    while 16**digits * 20_000 < rows or digits < 2:
        digits += 1
    lean = lean.withColumn("bucket", F.substring("order", 1, digits))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    parts = stored(lean.groupBy("source", "bucket").agg(F.sum("size").alias("bytes")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))).select(
        key.alias("_k"), "bucket", "offset"
    )
    goals = targets(parts.groupBy("source").agg(F.sum("bytes").alias("source_size")), schedules, cap)
    facts = offsets.join(goals.select(key.alias("_k"), "slot", "source_size", "target"), "_k")
    inside = (
        Window.partitionBy("_k", "bucket").orderBy("order", "doc_id", "size", *keep)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        lean.withColumn("_k", key)
        .withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(facts, ["_k", "bucket"])
        .withColumn("_start", F.col("offset") + F.col("_in"))
    )
    passes = F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    middle = F.col("_start") + F.col("size") / 2
    planned = (
        placed.withColumn("_passes", passes)
        .withColumn("copies", (F.col("_passes") + (middle < rest).cast("int")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    share = F.least(F.lit(1.0), middle / F.nullif(F.col("target"), F.lit(0.0)))
    when = _by_slot(F.col("slot"), [demand_time(share, k) for k in schedules])
    return planned.withColumn("position", F.when(F.col("copies") > 0, when)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken", "position", "slot",
        F.col("_start").alias("start"), *keep,
    )


def in_training_order(plan: DataFrame) -> DataFrame:
    """The plan's documents, range-sorted by position; documents that are not taken come last."""
    return plan.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id"
    )
