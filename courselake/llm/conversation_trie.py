"""Prefix trie of conversations by van Emde Boas recursion.

The trie of sequences of up to 2^K turns is cut at half depth: the cut prefixes are named, the
upper trie is built from the distinct upper halves and each lower forest from the sequences below
one cut prefix, and so on down to single turns. All tries and forests of one height are built in
one pass, so a trie takes K passes however many conversations there are and however long:

1. Halves, upward: a block of 2^k turns is named by a digest of its two halves' names.
2. Cuts, downward: a row is a distinct sequence of a block below a named prefix, with its number of
   conversations and its smallest one. It gives its upper half, merged with equal ones, and its
   lower half below the name of the cut prefix.
3. Block totals, upward: what lies below a prefix within its block of 2^k turns.
4. Grafts, downward: what lies below a cut prefix is its lower forest's total and, from every end
   of that forest, what was grafted there before.

No task holds a conversation, a node's conversations or a node's children as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courselake.llm.common import map_arrow, stored

ROOT = "root"
CHUNK = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key): the turns of each conversation, numbered from 1.

    Turns are in the order of ``turn``, null first, ties by role and then text. The key names the
    turn by a 128-bit digest of role and text and ends in the text's number of code points. Rows
    are numbered by range partition, so a conversation may span many tasks.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv_id", "turn", "role", "text", "tie"]
    named = F.concat(
        F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text").cast("binary")), F.lit(":"), F.length("text")
    )
    rows = stored(
        turns.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", named.alias("key"), F.monotonically_increasing_id().alias("row"))
    )
    part = F.shiftright("row", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per task
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.withColumn("part", part).join(offsets, "part").select(
        "conv_id", "key", (F.col("offset") + F.col("row") - F.shiftleft("part", 33)).alias("at")
    )
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return stored(placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "key"))


def lent(turns: DataFrame, lender: Column, most: Column, bound: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilds each conversation: the first ``most`` turns (at most ``bound``) of conversation
    ``lender``, all if fewer and none if absent, then its own turns after its first ``most``.

    ``lender`` and ``most`` are columns over conv_id. Returns the turns and the (conv_id) of all
    conversations, those without a turn too.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", lender.alias("lender"), most.alias("most"))
    lenders = convs.select(F.col("lender").alias("conv_id")).distinct()
    heads = stored(turns.where(F.col("pos") <= bound).join(lenders, "conv_id", "left_semi"))
    sizes = heads.groupBy(F.col("conv_id").alias("lender")).agg(F.count("*").alias("has"))
    plan = stored(
        convs.join(sizes, "lender", "left")
        .withColumn("taken", F.least("most", F.coalesce("has", F.lit(0))))
    )
    given = plan.join(heads.select(F.col("conv_id").alias("lender"), "pos", "key"), "lender").where("pos <= most")
    own = turns.join(plan.select("conv_id", "most", "taken"), "conv_id").where("pos > most")
    rebuilt = own.select("conv_id", (F.col("pos") - F.col("most") + F.col("taken")).alias("pos"), "key").union(
        given.select("conv_id", "pos", "key")
    )
    return rebuilt, plan.select("conv_id")


def _name(above: Column, key: Column) -> Column:
    return F.md5(F.concat(above, F.lit("/"), key).cast("binary"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the comma-joined ascending ids of each name's rows.

    Sorted ids are joined in pieces of about CHUNK bytes; a name's pieces are then hashed in
    order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["name", "first", "piece"]
            )

        for batch in batches:
            for here, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (here != name or size > CHUNK):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    name, first = here, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

        for batch in batches:
            for here, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != name:
                    if name is not None:
                        yield row()
                    name, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
        if name is not None:
            yield row()

    ordered = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    cut = map_arrow(ordered, pieces, "name string, first long, piece string")
    together = cut.repartition("name").sortWithinPartitions("name", "first").select("name", "piece")
    return map_arrow(together, digest, "name string, ends_sha256 string")


def _halves(turns: DataFrame, height: int) -> list[DataFrame]:
    """By level k: (conv_id, size, block, key, left, right) of the blocks of 2^k turns."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("size"))
    level = stored(
        turns.join(sizes, "conv_id").select("conv_id", "size", (F.col("pos") - 1).alias("block"), "key")
    )
    levels = [level]
    for _ in range(height):
        even = F.col("block") % 2 == 0
        level = stored(
            level.groupBy("conv_id", F.shiftright("block", 1).alias("half")).agg(
                F.max("size").alias("size"),
                F.max(F.when(even, F.col("key"))).alias("left"), F.max(F.when(~even, F.col("key"))).alias("right"),
            )
            .withColumnRenamed("half", "block")
            .withColumn("key", _name(F.col("left"), F.coalesce("right", F.lit(""))))
        )
        levels.append(level)
    return levels


def _ends(levels: list[DataFrame], convs: DataFrame) -> DataFrame:
    """(conv_id, name) of the node where each conversation ends: the blocks its length is made of,
    from the longest to the shortest, named one below the other."""
    parts = None
    for k, level in enumerate(levels):
        here = F.shiftright("size", k)
        part = level.where((here % 2 == 1) & (F.col("block") == here - 1)).select("conv_id", F.lit(-k).alias("k"), "key")
        parts = part if parts is None else parts.union(part)
    folded = F.aggregate(
        F.sort_array(F.collect_list(F.struct("k", "key"))), F.lit(ROOT), lambda name, part: _name(name, part["key"])
    )
    named = parts.groupBy("conv_id").agg(folded.alias("name"))
    return convs.join(named, "conv_id", "left").select("conv_id", F.coalesce("name", F.lit(ROOT)).alias("name"))


def _cuts(levels: list[DataFrame]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The trie's nodes (above, name, block, key, n_convs, first), and by level the cut prefixes:
    (above, cut, name) of each sequence of a block that goes on below the cut."""
    items = stored(
        levels[-1].groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("first"))
        .select(
            F.lit(ROOT).alias("above"), _name(F.lit(ROOT), F.col("key")).alias("name"),
            F.lit(0).cast("long").alias("block"), "key", "n_convs", "first",
        )
    )
    cuts: dict[int, DataFrame] = {}
    for k in range(len(levels) - 1, 0, -1):
        halves = levels[k].groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        both = stored(
            items.join(halves, "key").withColumn("cut", _name(F.col("above"), F.col("left")))
        )
        upper = both.groupBy("above", F.col("left").alias("key"), (F.col("block") * 2).alias("block")).agg(
            F.sum("n_convs").alias("n_convs"), F.min("first").alias("first")
        ).withColumn("name", _name(F.col("above"), F.col("key")))
        below = both.where("right is not null")
        lower = below.select(
            F.col("cut").alias("above"), "name", (F.col("block") * 2 + 1).alias("block"),
            F.col("right").alias("key"), "n_convs", "first",
        )
        cuts[k] = below.select("above", "cut", "name", "block")
        items = stored(upper.select(lower.columns).union(lower))
    return items, cuts


VALUES = ("leaves", "saved")


def _sums() -> list[Column]:
    return [F.sum(v).alias(v) for v in VALUES]


def _grafted(nodes: DataFrame, cuts: dict[int, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(name, values) strictly below each inner node, and the root's totals, from the nodes'
    own values."""
    height = len(cuts)
    totals = {0: stored(nodes.groupBy("above", (F.col("block")).alias("depth")).agg(*_sums()))}
    for k in range(1, height + 1):
        under = totals[k - 1]
        starts = under.where(F.col("depth") % (1 << k) == 0)
        below = cuts[k].select("above", "cut", (F.col("block") * (1 << k)).alias("depth")).distinct().join(
            under.select(F.col("above").alias("cut"), *VALUES), "cut"
        )
        totals[k] = stored(
            starts.select("above", "depth", *VALUES).union(below.select("above", "depth", *VALUES))
            .groupBy("above", "depth").agg(*_sums())
        )
    grafts: list[DataFrame] = []
    for k in range(height, 0, -1):
        forest = cuts[k].select("cut").distinct().join(totals[k - 1].select(F.col("above").alias("cut"), *VALUES), "cut")
        added = forest
        for earlier in grafts:
            added = added.union(cuts[k].join(earlier, "name").select("cut", *VALUES))
        grafts.append(stored(added.groupBy(F.col("cut").alias("name")).agg(*_sums())))
    whole = totals[height].where(F.col("above") == ROOT).select(*VALUES)
    below = None
    for graft in grafts:
        below = graft if below is None else below.union(graft)
    return below, whole


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations' turns, from the textless root at depth 0.

    ``turns`` has (conv_id, pos from 1 without gaps, key) as ``numbered`` gives them, ``convs`` all
    conversations, also those without turns. Columns: conv_id, the smallest member, where members
    are the conversations that start with the prefix; depth; parent_conv_id, that of the prefix
    without its last turn (root: null); n_convs, members; n_children; n_leaves, childless nodes in
    the node's subtree; saved_tokens, over the subtree the sum of each node's (n_convs - 1) times
    the code points of its last text; ends_sha256, of the ids that end at the node.

    No conversations give no rows; if all are without turns, the root is the only row, and a leaf.
    Prefixes are told apart by 128-bit digests.
    """
    convs = stored(convs)
    longest = turns.agg(F.max("pos")).first()[0] or 0
    whole = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    if not longest:
        ends = convs.select("conv_id", F.lit(ROOT).alias("name"))
        facts = whole.select(
            F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        )
        return _with_ends(facts, ends)
    levels = _halves(turns, (longest - 1).bit_length())
    ends = stored(_ends(levels, convs))
    items, cuts = _cuts(levels)
    children = items.groupBy(F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    characters = F.substring_index("key", ":", -1).cast("long")
    nodes = stored(
        items.join(children, "name", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * characters)
    )
    below, total = _grafted(nodes, cuts)
    parents = nodes.where("n_children > 0").select(F.col("name").alias("above"), F.col("first").alias("parent_conv_id"))
    top = whole.select(F.col("conv_id").alias("parent_conv_id"))
    linked = (
        nodes.where("block > 0").join(parents, "above")
        .unionByName(nodes.where("block = 0").withColumn("parent_conv_id", top.select("parent_conv_id").scalar()))
    )
    if below is not None:
        linked = linked.join(below.select("name", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")), "name", "left")
    else:
        linked = linked.withColumns({"more_leaves": F.lit(0), "more_saved": F.lit(0)})
    rows = linked.select(
        "name", F.col("first").alias("conv_id"), (F.col("block") + 1).alias("depth"), "parent_conv_id", "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    root = whole.select(
        F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        nodes.where("block = 0").agg(F.count("*")).scalar().alias("n_children"),
        total.select("leaves").scalar().alias("n_leaves"), total.select("saved").scalar().alias("saved_tokens"),
    )
    return _with_ends(rows.union(root), ends)


def _with_ends(rows: DataFrame, ends: DataFrame) -> DataFrame:
    none = F.lit(hashlib.sha256().hexdigest())
    return rows.join(ends_digests(ends), "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("name")


def spliced_trie(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the conversations rebuilt in blocks of ``block`` ids: conversation c starts with
    the first h turns of conversation c - c % block and goes on with its own after its first h,
    where h is crc32 of the decimal id modulo ``heads``.

    Rows without a conv_id take no part; null roles and texts count as empty; rows that repeat are
    turns of their own; extra columns are not read. The remainder has the id's sign.
    """
    own = numbered(conversations)
    most = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    turns, convs = lent(own, F.col("conv_id") - F.col("conv_id") % block, most, heads - 1)
    return prefix_trie(stored(turns), convs)
