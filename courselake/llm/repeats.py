"""Repeated strings by prefix-free parsing: phrases, suffix arrays of dictionary and parse, corpus order.

A string of ``length`` bytes that starts at p is repeated if it starts anywhere else too.

1. Phrases. A rolling hash of GRAM bytes is taken at every place. A string's trigger is the place of
   the least hash among its first ``reach`` places, the leftmost of equal ones, so equal strings have
   it at the same distance. Strings with one trigger start in a row: they begin in the phrase that
   ends at the trigger, and no trigger lies between.
2. Parse. What follows a trigger for the ``length - reach + 1`` bytes that all its strings reach is
   the trigger's class; strings of different classes differ. The phrase with all that its strings
   reach is the trigger's context. Classes and contexts are counted over all documents by 64-bit
   hashes each. A context that recurs repeats all its strings; a class with one context that does
   not recur repeats none; both need no more.
3. Corpus order. Of the classes left, the contexts' bytes are fetched. The suffixes of the dictionary,
   what lies between a string's start and its trigger, are sorted from the trigger backwards; the
   suffixes of the parse, what follows the trigger, forwards, both with the lengths that neighbours
   have in common. For each distance x from start to trigger, contexts in one run of the dictionary's
   order (x bytes in common) and in one run of the parse's order (length - x) have the same string.

Triggers as least hashes instead of hashes divisible by a number keep every phrase shorter than
``reach``, also in texts that repeat one byte. Tasks hold a bounded number of triggers or contexts: a class
with too many contexts is compared string by string, by 128-bit digests that Spark counts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.llm.common import map_arrow, scramble, stored, texts
from courselake.llm.packing import pack, unpack

GRAM = 12
STEP = 1 << 15
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
# a random value per byte
VALUES = scramble(np.arange(2000, 2256, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base), dtype=np.uint64)])


class Rolling:
    """Hashes of any piece of a text, by prefix sums of value times power modulo 2^64."""

    room = 2 * STEP + 4096  # what texts read together, or a step, take at most in the usual case
    forth, back = _powers(BASE, room), _powers(BACK, room)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n > self.room:
            self.forth, self.back = _powers(BASE, n), _powers(BACK, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * self.back[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.forth[begin]


def triggers(data: list[bytes], length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of each trigger of the texts: the text's number, the trigger's place, the first and last start
    of its strings, and hashes of its class and its context.

    Short texts are read together, long ones in steps, so memory does not grow with a text.
    """
    found: list[tuple[np.ndarray, ...]] = []
    some: list[int] = []
    size = 0
    for i, text in enumerate(data):
        if len(text) < length:
            continue
        if len(text) > STEP:
            at = 0
            while at <= len(text) - length:
                piece = text[at : at + STEP + length]
                got, done = _triggers_of([piece], length, reach, at + len(piece) == len(text))
                found.append((np.full(len(got[0]), i), *(c + at for c in got[1:4]), *got[4:]))
                at += done
            continue
        some.append(i)
        size += len(text)
        if size > STEP:
            found.append(_named(some, _triggers_of([data[i] for i in some], length, reach, True)[0]))
            some, size = [], 0
    if some:
        found.append(_named(some, _triggers_of([data[i] for i in some], length, reach, True)[0]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _named(numbers: list[int], got: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return (np.array(numbers)[got[0]], *got[1:])


def _triggers_of(pieces: list[bytes], length: int, reach: int, whole: bool) -> tuple[tuple[np.ndarray, ...], int]:
    """The triggers of these texts, and where to go on. A piece that is not a whole text leaves out
    its last trigger, whose strings may go on; the next piece starts with the first of them."""
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    rolling = Rolling(joined)
    gram = min(GRAM, length - reach + 1)
    n = len(joined) - length + 1  # places where a string may start
    m = n + reach - 1
    grams = scramble((rolling.sums[gram : gram + m] - rolling.sums[:m]) * rolling.forth[:m])
    least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    width = 1
    while width < reach:
        by = min(width, reach - width)
        least = np.minimum(least[: len(least) - by], least[by:])
        width += by
    trigger = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.r_[True, trigger[1:] != trigger[:-1]]
    sizes = np.array([len(p) for p in pieces])
    begins = np.r_[0, np.cumsum(sizes)]
    owner = np.zeros(len(joined), np.int32)
    owner[begins[1:-1]] = 1
    owner = np.cumsum(owner)[:n]
    if len(pieces) > 1:
        new |= np.r_[True, owner[1:] != owner[:-1]]
    first = np.flatnonzero(new)
    final = np.minimum(np.r_[first[1:], n] - 1, begins[owner[first] + 1] - length)
    inside = first <= final  # strings that cross into the next text are none
    first, final = first[inside], final[inside]
    done = len(joined)
    if not whole and len(first) > 1:
        done = int(first[-1])
        first, final = first[:-1], final[:-1]
    where, of = trigger[first], owner[first]
    kind = rolling.of(where, where + (length - reach + 1))
    shape = (where - first).astype(np.uint64) * np.uint64(1 << 32) + (final - first).astype(np.uint64)
    context = scramble(rolling.of(first, final + length) + scramble(shape))
    start = begins[of]
    return (of, where - start, first - start, final - start, scramble(kind), context), done


# ---- 2: classes and contexts, counted

# what a batch is told about a trigger
ALL, SHOW, WITNESS, SPLIT = 1, 2, 4, 8


def _asked(docs: DataFrame, length: int, reach: int, buckets: int, batch_bytes: int) -> DataFrame:
    """Per batch of documents and bucket of classes the triggers, and per batch one row of facts."""
    schema = "bucket int, batch string, kinds binary, contexts binary, owners binary, firsts binary, finals binary, places binary, many binary, facts binary"

    def flush(name: str, keys: list, found: list[bytes]) -> Iterator[pa.RecordBatch]:
        owner, place, first, final, kind, context = triggers(found, length, reach)
        owner = owner.astype(np.uint32)
        order = np.lexsort((owner, context, kind))
        owner, place, first, final, kind, context = (c[order] for c in (owner, place, first, final, kind, context))
        # a context that recurs in the batch is sent once; its strings are known to be repeated
        new = np.r_[True, (kind[1:] != kind[:-1]) | (context[1:] != context[:-1])] if len(kind) else np.zeros(0, bool)
        times = np.diff(np.r_[np.flatnonzero(new), len(kind)])
        known = np.repeat(times > 1, times)
        own = [pack(c[known]) for c in (owner, first, final)]
        facts = pickle.dumps((keys, own))
        columns = [c[new] for c in (kind, context, owner, first, final, place)] + [times > 1]
        bucket = (columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        rows = [(hash_of(name) % buckets, name, *[None] * 7, facts)]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        for begin, end in zip(edges, np.r_[edges[1:], len(bucket)]):
            k, c, o, f, l, p, m = (x[begin:end] for x in columns)
            rows.append(
                (int(bucket[begin]), name, pack(np.diff(k, prepend=np.uint64(0))), pack(c), pack(o), pack(f.astype(np.int64)),
                 pack((l - f).astype(np.uint16)), pack((p - f).astype(np.uint16)), pack(m.astype(np.uint8)), None)
            )
        names = ["bucket", "batch", "kinds", "contexts", "owners", "firsts", "finals", "places", "many", "facts"]
        types = [pa.int32(), pa.string(), *[pa.binary()] * 8]
        for begin in range(0, len(rows), 512):
            part = list(zip(*rows[begin : begin + 512]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names)

    def hash_of(name: str) -> int:
        return int.from_bytes(hashlib.md5(name.encode()).digest()[:4], "big")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        found: list[bytes] = []
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                keys.append((doc_id, hashlib.md5(data).hexdigest(), len(data), hashlib.sha256(data).hexdigest()))
                found.append(data)
                size += 200 + len(data)
                if size >= batch_bytes:
                    yield from flush(f"{task}-{n}", keys, found)
                    n, size, keys, found = n + 1, 0, [], []
        if keys:
            yield from flush(f"{task}-{n}", keys, found)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), ask, schema)


def _told(asked: DataFrame, most_contexts: int) -> DataFrame:
    """Per batch and bucket what each of its triggers is told; facts pass through."""

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, facts = pdf[pdf["facts"].isna()], pdf[pdf["facts"].notna()]
        out = [facts.assign(told=None)]
        if len(asks):
            kinds = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in asks["kinds"]]
            counts = np.array([len(k) for k in kinds])
            kind = np.concatenate(kinds)
            context = np.concatenate([unpack(c, np.uint64) for c in asks["contexts"]])
            many = np.concatenate([unpack(m, np.uint8) for m in asks["many"]]).astype(bool)
            order = np.lexsort((context, kind))
            k, c = kind[order], context[order]
            new_kind = np.r_[True, k[1:] != k[:-1]]
            new = new_kind | np.r_[True, c[1:] != c[:-1]]
            at = np.cumsum(new) - 1  # the distinct context of each trigger
            of = np.cumsum(new_kind) - 1  # its class
            times = np.bincount(at)
            repeated = (times > 1) | (np.bincount(at, many[order]) > 0)
            class_of = of[new]
            contexts = np.bincount(class_of)
            # of interest: classes of two contexts or more, one of which does not recur
            open_class = (contexts > 1) & (np.bincount(class_of, ~repeated) > 0)
            told = np.zeros(len(kind), np.uint8)
            told[repeated[at]] |= ALL
            asking = open_class[of] & ~repeated[at]
            told[asking] |= SHOW
            told[open_class[of] & repeated[at] & new] |= WITNESS  # one of equal contexts
            shown = (told & (SHOW | WITNESS)) > 0
            told[shown & (contexts > most_contexts)[of]] |= SPLIT
            reply = np.empty(len(kind), np.uint8)
            reply[order] = told
            replies = np.split(reply, np.cumsum(counts)[:-1])
            worth = [bool(r.any()) for r in replies]
            kept = asks[worth].assign(told=[pack(r) for r, w in zip(replies, worth) if w], contexts=None, many=None)
            out.append(kept)
        return pd.concat(out)[["batch", "kinds", "owners", "firsts", "finals", "places", "told", "facts"]]

    return asked.groupBy("bucket").applyInPandas(
        tell, "batch string, kinds binary, owners binary, firsts binary, finals binary, places binary, told binary, facts binary"
    )


PLAN = "doc_id long, digest string, n_bytes long, whole_sha256 string, marks binary, shows binary, covered boolean"


def _planned(told: DataFrame, length: int) -> DataFrame:
    """One row per document: size and digests, the starts known to be repeated, the contexts to show."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, own = pickle.loads(pdf[pdf["facts"].notna()]["facts"].iloc[0])
        marks = [[unpack(own[0], np.uint32), unpack(own[1], np.int64), unpack(own[2], np.int64)]]
        shows = []
        for row in pdf[pdf["facts"].isna()].itertuples(index=False):
            state = unpack(row.told, np.uint8)
            first = unpack(row.firsts, np.int64)
            columns = [unpack(row.owners, np.uint32), first, first + unpack(row.finals, np.uint16).astype(np.int64)]
            every = (state & ALL) > 0
            marks.append([c[every] for c in columns])
            show = (state & (SHOW | WITNESS)) > 0
            if show.any():
                kind = np.cumsum(unpack(row.kinds, np.uint64), dtype=np.uint64)
                place = first + unpack(row.places, np.uint16).astype(np.int64)
                shows.append([c[show] for c in (*columns, place, kind.view(np.int64), state.astype(np.int64))])
        marks = _by_owner([np.concatenate(c) for c in zip(*marks)], len(keys))
        shows = _by_owner([np.concatenate(c) for c in zip(*shows)], len(keys)) if shows else [None] * len(keys)
        rows = [(*k, m, s, bool(m) and covers(m, k[2])) for k, m, s in zip(keys, marks, shows)]
        names = ["doc_id", "digest", "n_bytes", "whole_sha256", "marks", "shows", "covered"]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def covers(packed: bytes, size: int) -> bool:
        spans = removed_spans(_rows_of(packed, 2), np.zeros(0, np.int64), length)
        return spans.tolist() == [[0, size]]

    return told.groupBy("batch").applyInPandas(gather, PLAN)


def _by_owner(columns: list[np.ndarray], n: int) -> list[bytes | None]:
    """The other columns' rows of each owner, packed side by side; None where there are none."""
    order = np.lexsort((columns[1], columns[0]))
    owner = columns[0][order]
    table = np.column_stack([c[order].astype(np.int64) for c in columns[1:]]) if len(owner) else np.zeros((0, len(columns) - 1), np.int64)
    edges = np.searchsorted(owner, np.arange(n + 1))
    return [pack(table[a:b].ravel()) if a < b else None for a, b in zip(edges[:-1], edges[1:])]


def _rows_of(packed: bytes | None, width: int) -> np.ndarray:
    return unpack(packed, np.int64).reshape(-1, width) if packed else np.zeros((0, width), np.int64)


# ---- 3: corpus order inside classes


def common_with_previous(strings: list[bytes], width: int) -> np.ndarray:
    """How many bytes each string of a sorted list shares with the one before; 0 for the first."""
    table = np.zeros((len(strings), width + 1), np.int16)
    for i, s in enumerate(strings):
        table[i, : len(s)] = np.frombuffer(s, np.uint8)
        table[i, len(s) :] = -1 - i % 2  # an end agrees with nothing
    differ = table[1:] != table[:-1]
    return np.r_[0, differ.argmax(axis=1)] if len(strings) > 1 else np.zeros(len(strings), int)


def repeated_starts(lefts: list[bytes], rights: list[bytes], spans: np.ndarray, sure: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the distances x from start to trigger whose string another context has too.

    ``lefts`` is a phrase up to its trigger, ``rights`` what follows from the trigger on, ``spans``
    the smallest and largest distance of the context's strings; ``sure`` contexts recur, so one
    of them is enough to repeat another's string.
    """
    n = len(lefts)
    backward = [s[::-1] for s in lefts]
    dictionary = sorted(range(n), key=backward.__getitem__)
    parse = sorted(range(n), key=rights.__getitem__)
    in_dictionary = common_with_previous([backward[i] for i in dictionary], max(map(len, lefts), default=0))
    in_parse = common_with_previous([rights[i] for i in parse], max(map(len, rights), default=0))
    found: list[list[int]] = [[] for _ in range(n)]
    weight = np.where(sure, 2, 1)
    run = np.empty(n, np.int64)
    rest = np.empty(n, np.int64)
    for x in range(int(spans[:, 0].min(initial=0)), int(spans[:, 1].max(initial=-1)) + 1):
        run[dictionary] = np.cumsum(in_dictionary < x)
        rest[parse] = np.cumsum(in_parse < length - x)
        have = np.flatnonzero((spans[:, 0] <= x) & (x <= spans[:, 1]))
        if len(have) < 2:
            continue
        _, at = np.unique(run[have] * (n + 1) + rest[have], return_inverse=True)
        for i in have[(np.bincount(at, weight[have])[at] > 1) & ~sure[have]]:
            found[i].append(x)
    return [np.array(f, np.int64) for f in found]


def _shown(some: DataFrame, length: int, buckets: int) -> DataFrame:
    """The contexts to compare, dealt by class: per document and bucket one row."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, shows, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                by: dict[int, list] = {}
                for first, final, place, kind, state in _rows_of(shows, 5).tolist():
                    if not state & SPLIT:
                        context = (data[first:place], data[place : final + length], place - final, place - first, bool(state & WITNESS), place)
                        by.setdefault((kind % (1 << 64)) * buckets >> 64, []).append(context)
                if by:
                    packed = [pickle.dumps(c) for c in by.values()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(by), pa.int32()), pa.array([key] * len(by)),
                            pa.array([pa.compress(p, "zstd", asbytes=True) for p in packed], pa.binary()),
                            pa.array([len(p) for p in packed], pa.int64()),
                        ],
                        ["bucket", "key", "contexts", "size"],
                    )

    return map_arrow(some.select("key", "shows", "text"), show, "bucket int, key string, contexts binary, size long")


def _split(some: DataFrame, length: int) -> DataFrame:
    """(key, starts) of the repeated strings of classes with very many contexts, counted one by one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, shows, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                rows = [
                    (p, hashlib.md5(data[p : p + length]).digest(), 2 if state & WITNESS else 1)
                    for first, final, _, _, state in _rows_of(shows, 5).tolist() if state & SPLIT
                    for p in range(first, final + 1)
                ]
                if rows:
                    start, digest, times = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(rows)), pa.array(start, pa.int64()), pa.array(digest, pa.binary()), pa.array(times, pa.int64())],
                        ["key", "start", "digest", "times"],
                    )

    strings = map_arrow(some.select("key", "shows", "text"), cut, "key string, start long, digest binary, times long")
    often = strings.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest")
    return strings.join(often, "digest").groupBy("key").agg(F.collect_list("start").alias("starts"))


def _ordered(shown: DataFrame, length: int) -> DataFrame:
    """(key, starts): the starts whose strings are repeated, per document."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        owners, contexts = [], []
        for key, packed, size in zip(pdf["key"], pdf["contexts"], pdf["size"]):
            some = pickle.loads(pa.decompress(packed, int(size), "zstd", asbytes=True))
            owners += [key] * len(some)
            contexts += some
        lefts, rights, near, far, sure, place = zip(*contexts)
        found = repeated_starts(list(lefts), list(rights), np.column_stack([near, far]), np.array(sure), length)
        starts: dict[str, list] = {}
        for key, at, distances in zip(owners, place, found):
            if len(distances):
                starts.setdefault(key, []).extend((at - distances).tolist())
        return pd.DataFrame({"key": list(starts), "starts": list(starts.values())}, columns=["key", "starts"])

    found = shown.groupBy("bucket").applyInPandas(compare, "key string, starts array<long>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def removed_spans(marks: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The maximal runs (begin, end) of bytes that the strings at these starts cover."""
    begin = np.r_[marks[:, 0], starts]
    end = np.r_[marks[:, 1], starts] + length
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.zeros(0, bool)
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1] if len(begin) else np.zeros(0, int)
    return np.column_stack([begin[new], end[last]]).reshape(-1, 2)


def repeated_spans(
    docs: DataFrame, length: int = 200, bucket_triggers: int = 1_000_000, batch_bytes: int = 16 << 20, most_contexts: int = 50_000
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (begin, end in bytes) and
    kept_sha256, with every byte removed that a ``length``-byte string covers which also starts
    anywhere else, in the same or another document.

    Texts are taken as UTF-8 bytes; a null text is empty. Matches never cross documents, and strings
    are judged on the input. Rows that repeat, or repeat an id, are documents of their own, so equal
    texts of ``length`` bytes or more lose everything. An empty table gives no rows; extra
    columns are not read. Documents that share id and text share a row inside.
    """
    reach = length // 2 + 1
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-2 * total // (reach * bucket_triggers)))
    told = _told(_asked(docs, length, reach, buckets, batch_bytes), most_contexts)
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest").cast("binary"))
    plans = stored(_planned(told, length).withColumn("key", key))
    # the texts that lose a part or have contexts to show, once per id and text
    touched = plans.where("shows is not null or (marks is not null and not covered)").dropDuplicates(["key"])
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    ).select(key.alias("key"), "text")
    some = stored(touched.select("key", "marks", "shows").join(own, "key").dropDuplicates(["key"]))
    size = some.agg(F.sum(F.length("shows"))).first()[0] or 0
    showing = some.where("shows is not null")
    ordered = _ordered(_shown(showing, length, max(1, -(-size // (1 << 20)))), length)
    starts = ordered.union(_split(showing, length)).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, marks, starts, data in zip(*(batch.column(i).to_pylist() for i in range(3)), texts(batch.column(3))):
                spans = removed_spans(_rows_of(marks, 2), np.array(starts or [], np.int64), length)
                kept, at = hashlib.sha256(), 0
                for begin, end in spans.tolist():
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                out.append((key, int((spans[:, 1] - spans[:, 0]).sum()), spans.tolist(), kept.hexdigest()))
            keys, removed, lists, digests = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(removed, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string())],
                ["key", "n_removed", "spans", "kept_sha256"],
            )

    cut = map_arrow(
        some.join(starts, "key", "left").select("key", "marks", "starts", "text"), remove,
        "key string, n_removed long, spans array<array<long>>, kept_sha256 string",
    )
    everything = F.col("covered") & F.col("n_removed").isNull()
    nothing = F.array().cast("array<array<bigint>>")
    return plans.join(cut, "key", "left").select(
        "doc_id", "n_bytes",
        F.when(everything, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(everything, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(everything, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    ).withColumn("n_spans", F.size("spans").cast("long"))
