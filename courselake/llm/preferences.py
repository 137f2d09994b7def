"""Preference formatting: chosen and rejected conversations as one prompt and two completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn(role: Column, text: Column) -> Column:
    """One rendered turn: a role header, the text, an end marker."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def pair_by_number(conversations: DataFrame) -> DataFrame:
    """Turns with (pair_id, side): conversations 2k and 2k+1 are chosen and rejected of pair k.

    Turns without a conversation id belong to no pair and are left out.
    """
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn", "role", "text",
    )


def pair_by_reply(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Turns with (pair_id, side): each conversation is chosen, and rejected with another's last reply.

    The pair's id is the conversation's. The rejected side has its turns before its last turn of the
    trained role, then the text of the last such turn of conversation 2k + 1 for 2k and the reverse;
    none where that one has no such turn. So both sides share all turns before the reply. Turns
    after it belong to the chosen side only. A conversation without a turn of the trained role is
    no pair, nor are turns without a conversation id. The last turn is that with the largest
    (turn, text), nulls lowest; rows equal to it are the same turn and are all replaced by one.
    Each conversation is reduced to one row before it is joined, and the larger side stays as it is.
    """
    known = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = (
        known.where(F.col("role") == trained_role)
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    other = last.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"), F.lit(True).alias("found")
    )
    facts = last.join(other, "conv_id", "left")
    chosen = known.join(last.select("conv_id"), "conv_id", "left_semi").select(
        F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text"
    )
    before = F.struct("turn", F.when(F.col("role") == trained_role, F.col("text")).alias("text")) < F.col("last")
    shared = known.join(last, "conv_id").where(before).select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text"
    )
    replies = facts.where("found").select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"),
        F.col("last.turn").alias("turn"), F.lit(trained_role).alias("role"), F.col("reply").alias("text"),
    )
    return chosen.unionByName(shared).unionByName(replies)


def preference_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair_id from turns (pair_id, side, turn, role, text).

    ``prompt`` is the longest common prefix of turns of both sides, rendered once; ``chosen`` and
    ``rejected`` are what is left of each. ``chosen_mask`` and ``rejected_mask`` are the
    character spans (start, length) of a completion that are trained on: text and end marker of
    the trained role's turns. Also ``prompt_turns``, ``chosen_turns``, ``rejected_turns``.

    Turns of a side are ordered by (turn, role, text), nulls first, and compared by place, role
    and text, so repeated turns stay in and gaps in the numbers don't matter. A null role renders
    as "unknown", a null text as "". If one side is missing, the pair has no common turn: the
    prompt is empty and the missing completion is "". Two equal conversations are all prompt.
    An empty table gives no rows; extra columns are not read.

    A conversation is one training example, so its turns meet in one row and nothing larger
    does: many equal conversations or first turns are separate pairs.
    """
    sides = turns.select("pair_id", "side", "turn", "role", "text").groupBy("pair_id").agg(
        *(
            F.array_sort(
                F.collect_list(F.when(F.col("side") == s, F.struct("turn", "role", "text")))
            ).alias(s)
            for s in ("chosen", "rejected")
        )
    )

    def plain(side: str) -> Column:
        return F.transform(
            side,
            lambda t: F.struct(
                F.coalesce(t["role"], F.lit("unknown")).alias("role"),
                F.coalesce(t["text"], F.lit("")).alias("text"),
            ),
        )

    both = sides.select("pair_id", plain("chosen").alias("c"), plain("rejected").alias("r"))
    shortest = F.least(F.size("c"), F.size("r"))
    # the place of the first pair of turns that differ, else the shorter side's length
    differ = F.array_position(
        F.transform(F.arrays_zip("c", "r"), lambda p: p["c"].eqNullSafe(p["r"])), F.lit(False)
    )
    cut = both.withColumn(
        "p", F.when(differ > 0, F.least(shortest, differ.cast("int") - 1)).otherwise(shortest)
    )
    split = cut.select(
        "pair_id",
        F.slice("c", F.lit(1), F.col("p")).alias("prompt_t"),
        F.slice("c", F.col("p") + 1, F.size("c")).alias("chosen_t"),
        F.slice("r", F.col("p") + 1, F.size("r")).alias("rejected_t"),
    )

    def rendered(name: str) -> Column:
        return F.concat_ws("", F.transform(name, lambda t: _turn(t["role"], t["text"])))

    def mask(name: str) -> Column:
        head = lambda t: F.length(t["role"]) + 5  # noqa: E731  <|role|> and a line feed
        body = lambda t: F.length(t["text"]) + 8  # noqa: E731  text, end marker, line feed
        start = F.struct(
            F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")
        )

        def step(acc: Column, t: Column) -> Column:
            span = F.array(F.struct((acc["at"] + head(t)).alias("start"), body(t).alias("length")))
            return F.struct(
                (acc["at"] + head(t) + body(t)).alias("at"),
                F.when(t["role"] == trained_role, F.concat(acc["spans"], span))
                .otherwise(acc["spans"]).alias("spans"),
            )

        return F.aggregate(name, start, step, lambda acc: acc["spans"])

    return split.select(
        "pair_id",
        rendered("prompt_t").alias("prompt"),
        rendered("chosen_t").alias("chosen"),
        rendered("rejected_t").alias("rejected"),
        mask("chosen_t").alias("chosen_mask"),
        mask("rejected_t").alias("rejected_mask"),
        F.size("prompt_t").alias("prompt_turns"),
        F.size("chosen_t").alias("chosen_turns"),
        F.size("rejected_t").alias("rejected_turns"),
    )
