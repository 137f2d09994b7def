"""N-gram Jaccard join by T-occurrence search: inverted lists of shingles, merged and probed.

A text at Jaccard similarity s or more to one of n shingles shares at least T = ceil(s n) of them.
So three steps, each of which loses no link:

1. Corpus-wide list lengths. A text with fewer than T shingles in lists of two or more texts has
   no partner. Batches ask for their distinct shingles by hash range; a shingle that a batch has
   twice is announced once, so a very common one counts once per batch.
2. Blocks. The shingles are dealt into parts by hash, one part more than two linked sets may differ
   in; so linked sets agree in a whole part. Texts that agree in one, directly or through others,
   form a block.
3. In a block, DivideSkip: of a text's inverted lists the longest are set aside, the short ones are
   merged to find the candidates that occur often enough, and these are looked up in the long
   ones by binary search. What reaches T is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil, floor, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.llm.common import (
    connected_components, map_arrow, scramble, shuffle_partitions, signed, small_batches, stored, texts,
    word_hashes,
)
from courselake.llm.packing import bucket_edges, pack, pack_sorted, unpack, unpack_sorted

BATCH_SHINGLES = 1_000_000
BATCH_TEXTS = 200_000
BUCKET_BYTES = 32 << 20  # of text whose shingles one range of hashes counts
BITS = 56
MOST_COPIES = 4  # of a set at once, on average, for the segments of its block


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``width`` words; of a shorter text, the
    one hash of all its words; of a text without words, none."""
    words = word_hashes(data.lower())
    if not len(words):
        return words
    wide = min(width, len(words))
    mixed = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        mixed = scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - wide + 1 + i])
    return np.unique(mixed)


def set_digest(hashes: np.ndarray) -> int:
    """One signed 64-bit number for the set."""
    return int(signed(scramble(np.array([scramble(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)))[0])


# ---- step 1: list lengths


def sketches(docs: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(doc_id, n, node, shared) per text: size and digest of its set, and how many of its
    shingles other texts have too."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), size // BUCKET_BYTES)
    asked_schema = (
        "bucket int, batch string, keys binary, owners binary, ids array<long>, sizes array<int>, nodes array<long>, own array<int>"
    )

    def flush(name: str, ids: list, sets: list) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        every = every >> np.uint64(64 - BITS)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        length = np.bincount(run) if len(run) else np.zeros(0, int)
        twice = length[run] > 1 if len(run) else np.zeros(0, bool)
        own = np.bincount(owner[twice], minlength=len(sets))
        keys = every[first]
        # owner + 1 of a shingle that one text of the batch has; 0 for one that several have
        owners = np.where(length > 1, 0, owner[first] + 1).astype(np.uint32) if len(keys) else np.zeros(0, np.uint32)
        edges = bucket_edges(keys, BITS, buckets)
        full = [i for i in range(buckets) if edges[i] < edges[i + 1]]
        none = [None] * len(full)
        lists = [
            pa.array([ids, *none], pa.list_(pa.int64())),
            pa.array([[len(s) for s in sets], *none], pa.list_(pa.int32())),
            pa.array([[set_digest(s) for s in sets], *none], pa.list_(pa.int64())),
            pa.array([own.tolist(), *none], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(
            [
                # the batch's own facts go to any bucket and pass through
                pa.array([hash_of(name) % buckets, *full], pa.int32()),
                pa.array([name] * (1 + len(full))),
                pa.array([None, *(pack_sorted(keys[edges[i] : edges[i + 1]]) for i in full)], pa.binary()),
                pa.array([None, *(pack(owners[edges[i] : edges[i + 1]]) for i in full)], pa.binary()),
                *lists,
            ],
            ["bucket", "batch", "keys", "owners", "ids", "sizes", "nodes", "own"],
        )

    def hash_of(name: str) -> int:
        return int.from_bytes(name.encode(), "big") % 1_000_003

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sets: list = []
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids.append(doc_id)
                sets.append(shingles(data, width))
                size += len(sets[-1])
                if size >= BATCH_SHINGLES or len(ids) >= BATCH_TEXTS:
                    yield flush(f"{task}-{n}", ids, sets)
                    n, size, ids, sets = n + 1, 0, [], []
        if ids:
            yield flush(f"{task}-{n}", ids, sets)

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, facts = pdf[pdf["keys"].notna()], pdf[pdf["keys"].isna()]
        out = facts[["batch", "ids", "sizes", "nodes", "own"]].assign(counts=None)
        if len(asks):
            own = [unpack_sorted(k) for k in asks["keys"]]
            owners = [unpack(o, np.uint32) for o in asks["owners"]]
            _, at, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            shared = np.split(times[at] > 1, np.cumsum([len(k) for k in own])[:-1])
            counts = [pack(np.bincount(o[s & (o > 0)]).astype(np.uint32)) for o, s in zip(owners, shared)]
            told = pd.DataFrame({"batch": asks["batch"].to_numpy(), "counts": counts})
            out = pd.concat([out, told.assign(ids=None, sizes=None, nodes=None, own=None)])
        return out[["batch", "ids", "sizes", "nodes", "own", "counts"]]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        fact = pdf[pdf["counts"].isna()].iloc[0]
        shared = np.array(fact["own"], np.int64)
        for counts in pdf["counts"].dropna():
            c = unpack(counts, np.uint32)[1:]
            shared[: len(c)] += c
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if i is None or i != i else int(i) for i in fact["ids"]], "Int64"),
                "n": np.array(fact["sizes"], np.int64), "node": np.array(fact["nodes"], np.int64), "shared": shared,
            }
        )

    asked = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), ask, asked_schema)
    told = asked.groupBy("bucket").applyInPandas(
        lengths, "batch string, ids array<long>, sizes array<int>, nodes array<long>, own array<int>, counts binary"
    )
    return told.groupBy("batch").applyInPandas(total, "doc_id long, n long, node long, shared long")


# ---- step 2: blocks


def band_edges(similarity: Fraction, size: int) -> list[int]:
    """Size bands so that linked sets lie in the same or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= size:
        edges.append(max(edges[-1] + 1, ceil(edges[-1] / similarity)))
    return edges


def parts_of_band(similarity: Fraction, upper: int) -> tuple[int, int]:
    """(parts, empty parts allowed for) of sets whose smaller side has fewer than ``upper``.

    The larger has at most (upper - 1) / s shingles, and both differ in at most
    (1 - s) / (1 + s) of their sizes' sum.
    """
    differ = floor((upper - 1) * (1 + 1 / similarity) * (1 - similarity) / (1 + similarity))
    spare = 0 if not differ else 1 + floor((differ + 1) * 0.08)
    return differ + 1 + spare, spare


def signatures(hashes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """A number per whole part of the set, for its own size band and the one below.

    ``differ`` differences reach at most so many parts, so two linked sets agree in at least
    1 + spare parts. A set with at most ``spare`` empty parts leaves these out and still has a
    filled part in common; a set with more gives its empty parts too.
    """
    edges = band_edges(similarity, len(hashes))
    band = len(edges) - 2
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        parts, spare = parts_of_band(similarity, edges[b + 1])
        part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        sums = np.zeros(parts, np.uint64)
        begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])  # hashes are sorted, so are parts
        filled = part[begins].astype(np.int64)
        sums[filled] = np.add.reduceat(scramble(hashes), begins)
        use = filled if parts - len(filled) <= spare else np.arange(parts)
        out.append(scramble(sums[use] + scramble(use.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(b))))
    return signed(np.concatenate(out))


def _sets(docs: DataFrame, kept: DataFrame, width: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(node, copies, n, hashes) of the kept (doc_id, node, copies): one text per node.

    The kept ids are sent to the texts if they are proven few (64 bytes each in a hash relation),
    else both are shuffled by id.
    """
    small_batches(docs.sparkSession)
    few = F.broadcast(kept) if kept.count() * 64 <= most_bytes else kept
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(1).to_numpy()
            sets = [shingles(data, width) for data in texts(batch.column(0))]
            same = [i for i, s in enumerate(sets) if len(s) and set_digest(s) == node[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[same]), pa.array(batch.column(2).to_numpy()[same]),
                    pa.array([len(sets[i]) for i in same], pa.int64()),
                    pa.array([pack_sorted(sets[i]) for i in same], pa.binary()),
                ],
                ["node", "copies", "n", "hashes"],
            )

    schema = "node long, copies long, n long, hashes binary"
    return map_arrow(joined.select("text", "node", "copies"), build, schema).dropDuplicates(["node"])


def _blocks(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(node, block) of the sets that agree with another in a part."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signatures(unpack_sorted(h.as_py()), similarity) for h in batch.column(1)]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column(0).to_numpy(), [len(m) for m in made])),
                        pa.array(np.concatenate(made)),
                    ],
                    ["node", "signature"],
                )

    signed_sets = map_arrow(sets.select("node", "hashes"), sign, "node long, signature long")
    centres = (
        signed_sets.groupBy("signature").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
        .where("centre < last").select("signature", "centre")
    )
    edges = signed_sets.join(centres, "signature").where("node <> centre").select(
        F.col("node").alias("a"), F.col("centre").alias("b")
    )
    return connected_components(edges)


# ---- step 3: search inside a block


class Lists:
    """Inverted lists of the shingles that at least two of the sets have."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.keys, self.begins = every[begins], np.r_[begins, len(every)]

    def of(self, hashes: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == hashes]
        return [self.owner[self.begins[i] : self.begins[i + 1]] for i in at]


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and how many lists each is in. The stable sort merges the sorted
    runs, as a heap of list heads would."""
    run = np.sort(np.concatenate(lists), kind="stable")
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return run[first], np.diff(np.r_[first, len(run)])


def divide_skip(lists: list[np.ndarray], least: int, tuning: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least ``least`` of the sorted lists, with their counts."""
    lists = sorted(lists, key=len)
    if len(lists) < least or not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n_long = min(int(least / (tuning * log2(len(lists[-1]) + 1) + 1)), least - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    members, counts = merged(short)
    often = counts >= least - n_long
    members, counts = members[often], counts[often]
    for done, probed in enumerate(long):
        if not len(members):
            break
        at = np.minimum(np.searchsorted(probed, members), len(probed) - 1)
        counts = counts + (probed[at] == members)
        alive = counts >= least - (n_long - done - 1)
        members, counts = members[alive], counts[alive]
    return members, counts


def linked_within(
    nodes: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, asks: np.ndarray, listed: np.ndarray,
    similarity: Fraction,
):
    """Each asking set against the listed ones: edges (node, node) that connect what links connect,
    and per set the copies that it links with among those compared. A pair of sets that both ask
    and are listed is met from both sides, any other pair from one and counted for both."""
    top, bottom = similarity.numerator, similarity.denominator
    size = np.array([len(s) for s in sets])
    place = np.flatnonzero(listed)
    lists = Lists([sets[i] for i in place])
    group = np.arange(len(sets))  # smallest place in each connected group, kept flat
    edges, partners = [], np.zeros(len(sets), np.int64)
    for i in np.flatnonzero(asks):
        least = ceil(size[i] * similarity)
        members, counts = divide_skip(lists.of(sets[i]), least)
        other = place[members]
        near = other[(other != i) & (bottom * counts >= top * (size[i] + size[other] - counts))]
        partners[i] += copies[near].sum()
        once = near if not listed[i] else near[~asks[near]]
        partners[once] += copies[i]
        for j in near[group[near] != group[i]]:
            if group[j] != group[i]:
                a, b = sorted((group[i], group[j]))
                group[group == b] = a
                edges.append((nodes[i], nodes[j]))
    return edges, partners


def _links(sets: DataFrame, blocks: DataFrame, similarity: Fraction, block_shingles: int) -> DataFrame:
    """(a, b, partners) by block: edges between linked nodes with 0 partners, and a row (node, node,
    copies it links with) per group that found some. A block above ``block_shingles`` is cut into
    segments, and each pair of segments is one group: the first one's sets ask, the second one's are
    listed. So a task holds two segments at most, however large the block.

    A set is copied once for each segment of its block. Where the copies are more than MOST_COPIES times
    the sets, the groups are dealt into rounds of about so many, whose shuffles follow each other on disk.
    """
    own = sets.join(blocks, "node")
    segments = stored(
        own.groupBy("label").agg(
            F.least(F.count("*"), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("segments"),
            F.sum("n").alias("shingles"),
        )
    )
    copies = segments.agg(F.sum(F.col("shingles") * F.col("segments")) / F.sum("shingles")).first()[0] or 0
    rounds = max(1, ceil(copies / MOST_COPIES))
    home = F.pmod(F.xxhash64("node"), F.col("segments")).cast("int")
    placed = (
        own.join(segments.select("label", "segments"), "label").withColumn("home", home)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        .select(
            "label", F.least("home", "other").alias("first"), F.greatest("home", "other").alias("second"),
            (F.col("home") <= F.col("other")).alias("asks"), (F.col("home") >= F.col("other")).alias("listed"),
            "node", "copies", "hashes",
        )
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes = pdf["node"].to_numpy()
        sets = [unpack_sorted(h) for h in pdf["hashes"]]
        asks, listed = pdf["asks"].to_numpy(bool), pdf["listed"].to_numpy(bool)
        if not listed.any():
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("a", "b", "partners")})
        edges, partners = linked_within(nodes, sets, pdf["copies"].to_numpy(np.int64), asks, listed, similarity)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        some = partners > 0
        return pd.DataFrame(
            {
                "a": np.r_[ends[:, 0], nodes[some]], "b": np.r_[ends[:, 1], nodes[some]],
                "partners": np.r_[np.zeros(len(ends), np.int64), partners[some]],
            }
        )

    def searched(some: DataFrame) -> DataFrame:
        return some.groupBy("label", "first", "second").applyInPandas(search, "a long, b long, partners long")

    if rounds == 1:
        return searched(placed)
    turn = F.pmod(F.xxhash64("label", "first", "second"), F.lit(rounds))
    return reduce(DataFrame.unionByName, [stored(searched(placed.where(turn == i))) for i in range(rounds)])


def ngram_components(
    docs: DataFrame, width: int = 3, similarity: Fraction = Fraction(9, 10), block_shingles: int = 1_500_000
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per document: the size of its set of distinct runs
    of ``width`` words (A-Z in lower case), the smallest doc_id that links reach, itself included, and
    the number of other rows it links with.

    Two documents link if their sets' Jaccard similarity reaches ``similarity``; equal sets are one
    node, so groups of copies cost one search. A text without words, or null, has no shingles and
    links with nothing; a null doc_id links with nothing and has a null component. Rows are judged
    by their text: rows that repeat, or repeat an id, each get a row. An empty table gives no rows;
    extra columns are not read. Shingles and sets are told apart by 64-bit hashes.
    """
    sketch = stored(sketches(docs, width, similarity))
    linkable = sketch.where("n > 0 and doc_id is not null")
    enough = F.ceil(F.col("n") * F.lit(similarity.numerator) / F.lit(similarity.denominator))
    kept = linkable.where(F.col("shared") >= enough).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    sets = stored(_sets(docs, stored(kept.select("doc_id", "node", "copies")), width))
    blocks = stored(_blocks(sets, similarity))
    links = stored(_links(sets, blocks, similarity, block_shingles))
    groups = connected_components(links)
    # copies of a text share a node; they are counted as one before anything is joined by node
    none = F.lit(None).cast("long")
    of_node = (
        linkable.select("node", "doc_id", F.lit(1).cast("long").alias("links"), none.alias("label"))
        .unionByName(groups.select("node", none.alias("doc_id"), F.lit(0).cast("long").alias("links"), "label"))
        .unionByName(links.where("a = b").select(F.col("a").alias("node"), none.alias("doc_id"), F.col("partners").alias("links"), none.alias("label")))
        .groupBy("node").agg(
            F.min("doc_id").alias("first"), (F.sum("links") - 1).alias("n_links"),
            F.coalesce(F.min("label"), F.col("node")).alias("label"),
        )
    )
    least = of_node.groupBy("label").agg(F.min("first").alias("component_id"))
    named = of_node.join(least, "label").select("node", "component_id", "n_links")
    alone = F.when((F.col("n") == 0), F.col("doc_id"))
    can_link = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return sketch.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "component_id")).alias("component_id"),
        F.when(can_link, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    )
