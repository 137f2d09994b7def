"""Toxicity by two Kneser-Ney models over bytes, one per class, with shared lower orders.

The signals are the difference of both log-likelihoods, normalised by length, of the whole text,
and those of its most toxic words, so a long document is judged by its worst part too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from courselake.llm.common import SPACE, WORD, learns, map_arrow, shared, slices, small_batches, stored, texts

ORDER = 5
STRONG = 7.0  # log ratio of a word from which it counts as a toxic one
N_FEATURES = 4


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes that end at each place, packed in one integer."""
    out = np.zeros(len(data) - order + 1, np.uint64)
    for i in range(order):
        out = (out << np.uint64(8)) | data[i : len(data) - order + 1 + i]
    return out


def apart(text: bytes) -> bytes:
    """Lower case, words so far apart that no gram spans two of them."""
    return (b" " * (ORDER - 1)).join(text.lower().split())


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " * (ORDER - 1) + apart(text) + b" ", np.uint8)


@dataclass
class Ratios:
    """Log ratio (toxic to ordinary) of each known ORDER-gram, and of a backoff per context.

    Kept in hash tables of one entry per slot, each with its key to tell strangers.
    """

    full: list
    back: list
    rest: float

    @staticmethod
    def table(keys: np.ndarray, values: np.ndarray) -> list:
        """Up to eight tables; what a table has no slot for goes to the next."""
        out = []
        for turn in range(8):
            if not len(keys):
                break
            bits = max(8, int(np.ceil(np.log2(len(keys)))) + 2)
            slot = Ratios.slot(keys, turn, bits)
            last, at = np.unique(slot, return_index=True)
            known, value = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.float32)
            known[last], value[last] = keys[at], values[at]
            out.append((bits, known, value))
            left = np.ones(len(keys), bool)
            left[at] = False
            keys, values = keys[left], values[left]
        return out

    @staticmethod
    def slot(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 2 * turn * 0x632BE59BD9B4E019) % 2**64 | 1)
        return ((keys * odd) >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def look(tables: list, keys: np.ndarray, out: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Fills ``out`` for the places ``todo``; returns the places whose key is unknown."""
        for turn, (bits, known, value) in enumerate(tables):
            if not len(todo):
                break
            slot = Ratios.slot(keys[todo], turn, bits)
            same = known[slot] == keys[todo]
            out[todo[same]] = value[slot[same]]
            todo = todo[~same]
        return todo

    def of(self, data: np.ndarray) -> np.ndarray:
        keys = _grams(data, ORDER)
        out = np.full(len(keys), self.rest, np.float32)
        todo = self.look(self.full, keys, out, np.arange(len(keys)))
        if len(todo):
            self.look(self.back, keys >> np.uint64(8), out, todo)
        return out


def ratios(counts: dict[int, tuple[np.ndarray, np.ndarray]], discount: float = 0.75) -> Ratios:
    """From the counts of ORDER-grams per class (0 and 1) to log ratios.

    P_c(b | h) = max(n_c(hb) - d, 0) / n_c(h) + d N_c(h) / n_c(h) * S(b | h'), where N_c(h) is the
    number of followers of h in the class, h' the context without its first byte, and S the
    Kneser-Ney model of both classes together: continuation counts, recursively down to uniform.
    A context that a class has never seen takes S alone.
    """
    keys = np.unique(np.concatenate([counts[0][0], counts[1][0]]))
    n = np.zeros((2, len(keys)))
    for c in (0, 1):
        n[c, np.searchsorted(keys, counts[c][0])] = counts[c][1]

    def lower_order(grams: np.ndarray, size: int) -> np.ndarray:
        """S of each gram's last byte after its other size - 1 bytes, ``grams`` distinct and sorted,
        all distinct grams of that size."""
        if size == 0:
            return np.full(len(grams), 1 / 256)
        mask = np.uint64((1 << (8 * size)) - 1)
        # continuation count: distinct bytes seen before the gram
        longer = np.unique(keys & np.uint64((1 << (8 * (size + 1))) - 1))
        mine, times = np.unique(longer & mask, return_counts=True)
        context, where, followers = np.unique(mine >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(where, weights=times)
        lower_keys = np.unique(mine & np.uint64((1 << (8 * (size - 1))) - 1)) if size > 1 else np.zeros(1, np.uint64)
        lower = lower_order(lower_keys, size - 1)
        at = np.searchsorted(lower_keys, mine & np.uint64((1 << (8 * (size - 1))) - 1)) if size > 1 else np.zeros(len(mine), int)
        p = np.maximum(times - discount, 0) / total[where] + discount * followers[where] / total[where] * lower[at]
        return p[np.searchsorted(mine, grams)]

    short = keys & np.uint64((1 << (8 * (ORDER - 1))) - 1)
    short_keys, short_at = np.unique(short, return_inverse=True)
    s = lower_order(short_keys, ORDER - 1)[short_at]
    context, where = np.unique(keys >> np.uint64(8), return_inverse=True)
    p, weight = np.zeros((2, len(keys))), np.ones((2, len(context)))
    for c in (0, 1):
        total = np.bincount(where, weights=n[c])
        followers = np.bincount(where, weights=n[c] > 0)
        some = total > 0
        weight[c, some] = discount * followers[some] / total[some]
        seen = np.divide(np.maximum(n[c] - discount, 0), total[where], out=np.zeros(len(keys)), where=total[where] > 0)
        p[c] = seen + weight[c, where] * s
    full = np.log(p[1]) - np.log(p[0])
    back = np.log(weight[1]) - np.log(weight[0])
    return Ratios(Ratios.table(keys, full), Ratios.table(context, back), 0.0)


def _features(data: bytes, model: Ratios) -> tuple[float, ...]:
    """From the log ratio of each byte, summed by word (with the white space after it): the
    mean per byte; the largest word and the mean of the largest two; the mean excess over
    STRONG per word. All 0 for an empty text."""
    total = excess = 0.0
    words, top = 0, np.zeros(0)
    for at, end in slices(data):
        head = min(at, ORDER - 1)
        part = np.frombuffer(b" " * (ORDER - 1 - head) + data[at - head : end], np.uint8)
        r = model.of(part)
        space = SPACE[part[ORDER - 1 :]]
        begins = np.flatnonzero(np.r_[True, space[:-1] & ~space[1:]])
        by_word = np.add.reduceat(r.astype(float), begins)
        total += float(by_word.sum())
        excess += float(np.maximum(by_word - STRONG, 0).sum())
        words += len(by_word)
        top = np.sort(np.concatenate([top, by_word]))[-2:]
    if not words:
        return (0.0,) * N_FEATURES
    return total / len(data), float(top[-1]), float(top.mean()), excess / words


@dataclass
class Classifier:
    model: Ratios
    weights: np.ndarray  # of the features and 1

    def scores(self, documents: Iterator[bytes]) -> np.ndarray:
        x = np.array([[*_features(apart(d), self.model), 1.0] for d in documents]).reshape(-1, N_FEATURES + 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; x has a last column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> Classifier | None:
    """Learns from a bounded sample: of each class, at most ``per_class`` labelled documents, those
    with the smallest digests of their ids. Held-out rows (crc32 of the id mod 5 is 0) are no part
    of it. The features' weights are learned on six of each sixteen documents of
    a class, by rank of their digests, under the counts of the rest; then all of it is counted.
    None if a class has fewer than two documents.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & learns(F.col("doc_id"), 5, 0)).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    )
    # one label per document: the larger, should they differ
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = None
    for c in (0, 1):
        some = marked.where(F.col("toxic") == c).orderBy(order).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = stored(chosen)
    small_batches(spark)
    few = F.broadcast(chosen)  # at most 2 * per_class rows of two numbers
    sample = stored(docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "text", "toxic"))
    # at most 2 * per_class rows; texts with words come first, as only they teach grams
    words = F.max(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    ranked = sample.groupBy("doc_id", "toxic").agg(words.alias("words")).orderBy(F.desc("words"), order).collect()
    halves = [(r["doc_id"], int(n % 8 in (1, 4, 6))) for c in (0, 1) for n, r in enumerate(r for r in ranked if r["toxic"] == c)]
    of_id = spark.createDataFrame(halves, StructType([sample.schema["doc_id"], StructField("half", IntegerType())]))
    sample = stored(sample.join(F.broadcast(of_id), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[tuple[int, int], list] = {}
            for half, y, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(0))):
                parts.setdefault((half, y), []).append(_grams(_padded(data), ORDER))
            for (half, y), own in parts.items():
                keys, times = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), half, np.int32)), pa.array(np.full(len(keys), y, np.int32)),
                        pa.array(keys.view(np.int64)), pa.array(times),
                    ],
                    ["half", "toxic", "gram", "n"],
                )

    grams = map_arrow(sample.select("text", "half", "toxic"), count, "half int, toxic int, gram long, n long")
    # as many rows as the bounded sample has distinct grams
    summed = grams.groupBy("toxic", "gram").agg(
        F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("first"), F.sum("n").alias("all")
    ).toPandas()

    def counts(which: str) -> dict:
        own = {c: summed[(summed["toxic"] == c) & (summed[which] > 0)] for c in (0, 1)}
        return {c: (x["gram"].to_numpy(np.int64).view(np.uint64), x[which].to_numpy(float)) for c, x in own.items()}

    if not all(len(k) for k, _ in counts("first").values()):
        return None
    model = ratios(counts("first"))
    the_model = shared(spark, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(_features(apart(d), the_model())) for d in texts(batch.column(0))], pa.list_(pa.float64())), batch.column(1)],
                ["x", "toxic"],
            )

    seen = map_arrow(sample.where("half = 1").select("text", "toxic"), measure, "x array<double>, toxic int")
    seen = seen.orderBy("x", "toxic").toPandas()
    if seen["toxic"].nunique() < 2:
        return None
    x = np.column_stack([np.array(seen["x"].tolist()), np.ones(len(seen))])
    scale = np.r_[x[:, :-1].std(axis=0) + 1e-12, 1.0]
    return Classifier(ratios(counts("all")), _logistic(x / scale, seen["toxic"].to_numpy(float)) / scale)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5), for every whole text.

    Only the text is an input. A null text counts as empty; a null id is not held out. Without
    labels of both classes every score is 0. Repeated rows get equal scores; other columns are
    kept, columns named held_out, score or predicted are replaced. An empty table gives no rows.
    """
    classifier = fit(docs, labels, per_class)
    docs = docs.drop("held_out", "score", "predicted")
    held = ~learns(F.col("doc_id"), 5, 0)
    if classifier is None:
        return docs.withColumns(
            {"held_out": held, "score": F.lit(0.0), "predicted": F.lit(0)}
        )
    the_classifier = shared(docs.sparkSession, classifier)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = the_classifier().scores(texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    small_batches(docs.sparkSession)
    schema = docs.withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(score, schema).withColumns(
        {"held_out": held, "predicted": (F.col("score") >= 0.5).cast("int")}
    )
