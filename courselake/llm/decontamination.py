"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages of words, weighted with TF-IDF and projected
on the leading right singular vectors of the passage matrix (randomised SVD, summed over tasks).
Where a document can hold an item at all, by a bound that loses nothing, its passages are compared
with the item's: those whose cosine reaches a threshold are looked at first, closest first, then
every other place. The longest common subsequence of the item's words, and the item's answer, decide.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.llm.common import map_arrow, shared, small_batches, stored, word_hashes

FEATURES = 1 << 18
CHUNKS = 16
PASSAGE, STRIDE, ITEM_STRIDE = 24, 8, 12
RANK, OVERSAMPLE, ROUNDS = 128, 16, 2
BLOCK = 32
CELLS = 1 << 20  # counts of a block of words by item that are held at a time
BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def terms(text: str) -> np.ndarray:
    """The feature of each word of the text: lower case, punctuation apart."""
    hashes = word_hashes(text.lower().encode().translate(BLANK))
    return (hashes & np.uint64(FEATURES - 1)).astype(np.int64)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of packed float64 blocks by chunk; as large as the model, whatever the corpus."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["block"].iloc[0]).copy()
        for block in pdf["block"].iloc[1:]:
            total += np.frombuffer(block)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "block": [total.tobytes()]})

    lanes = parts.groupBy("chunk").applyInPandas(add, "chunk int, block binary")
    return {r["chunk"]: np.frombuffer(r["block"]) for r in lanes.collect()}


def _in_chunks(values: np.ndarray) -> pa.RecordBatch:
    blocks = np.array_split(values, CHUNKS)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["chunk", "block"]
    )


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents have each feature, counted over all whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES)
        for batch in batches:
            for text in batch.column(0):
                total[np.unique(terms(text.as_py() or ""))] += 1
        yield _in_chunks(total)

    sums = _summed(map_arrow(docs.select("text"), count, "chunk int, block binary"))
    return np.concatenate([sums[c] for c in range(CHUNKS)]) if sums else np.zeros(FEATURES)


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    masks: dict = field(default_factory=dict)

    @property
    def slack(self) -> int:
        return len(self.words) // 4 + STRIDE

    @property
    def reach(self) -> int:
        """Words of a place: the item's, with the slack before and after."""
        return len(self.words) + 2 * self.slack


def answer_of(text: str) -> str:
    """The last sentence; of a text of one sentence, or with a last one under three words, the
    last third of the words."""
    sentences = [s for s in text.replace("?", ".").replace("!", ".").replace("\n", " ").split(".") if s.strip()]
    if len(sentences) > 1 and len(sentences[-1].split()) >= 3:
        return sentences[-1]
    words = text.split()
    return " ".join(words[-max(1, len(words) // 3) :])


def bit_masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_length(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the first sequence."""
    whole = (1 << length) - 1
    v = whole
    for w in other:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & whole
    return length - v.bit_count()


@dataclass
class Index:
    """Items, their passages in the latent space, and the rarest words of each."""

    items: list[Item]
    idf: np.ndarray
    slot: np.ndarray  # feature -> row of basis, or -1
    basis: np.ndarray
    passages: np.ndarray  # unit rows, by item
    offset: np.ndarray  # first word of each in the item
    begins: np.ndarray  # first passage of each item, and their number
    posted: np.ndarray  # first of each slot's entries in asking, and their number
    asking: np.ndarray  # items by slot, as often as the word is among the item's rarest
    least: np.ndarray  # how many of its rarest words a place must have, by item

    def possible(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows (text, item, word) such that places that begin in the BLOCK words from there may
        hold the item; all others have too few of its rarest words."""
        n = np.array([len(t) for t in texts], np.int64)
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        slot = self.slot[words]
        block = np.repeat(first, n) + (np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)) // BLOCK
        times = np.where(slot >= 0, self.posted[slot + 1] - self.posted[slot], 0)
        asked = np.flatnonzero(times)
        slot, block, times = slot[asked], block[asked], times[asked]
        spans = np.array([(BLOCK + item.reach - 2) // BLOCK + 1 for item in self.items])
        widest, width = int(spans.max()), len(self.items)
        lanes = max(CELLS // width, 4 * widest)
        found = [np.zeros((0, 3), np.int64)]
        for at in range(0, total, lanes):
            low, high = np.searchsorted(block, [at, at + lanes + widest])
            many, begin = times[low:high], self.posted[slot[low:high]]
            entry = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = np.repeat((block[low:high] - at + 1) * width, many) + self.asking[entry]
            counts = np.bincount(cell, minlength=(lanes + widest + 1) * width).reshape(-1, width).astype(np.int32)
            sums = np.cumsum(counts, axis=0, out=counts)
            for span in np.unique(spans):
                own = np.flatnonzero(spans == span)
                row, column = np.nonzero(sums[span : span + lanes, own] - sums[:lanes, own] >= self.least[own])
                row = row + at
                row, column = row[row < total], column[row < total]
                text = np.searchsorted(first, row, "right") - 1
                found.append(np.column_stack([text, own[column], (row - first[text]) * BLOCK]))
        rows = np.concatenate(found)
        return rows[np.lexsort(rows.T[::-1])]

    def closeness(self, text: np.ndarray, item: int, low: int, high: int) -> list[tuple[float, int]]:
        """(cosine, word where the item would begin) of each pair of a passage of the text that
        begins from ``low`` to ``high`` and one of the item's, closest first."""
        start = np.arange(low, min(high, len(text)), STRIDE)
        spot = start[:, None] + np.arange(PASSAGE)
        inside = spot < len(text)
        here = text[np.where(inside, spot, 0)]
        slots = self.slot[here]
        factor = np.where(inside & (slots >= 0), self.idf[here], 0)
        latent = np.einsum("ij,ijk->ik", factor, self.basis[np.maximum(slots, 0)])
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
        own = slice(self.begins[item], self.begins[item + 1])
        close = latent @ self.passages[own].T
        begin = start[:, None] - self.offset[own]
        order = np.argsort(-close, axis=None, kind="stable")
        return list(zip(close.ravel()[order].tolist(), begin.ravel()[order].tolist()))

    def hits(self, texts: list[np.ndarray], cosine: float, sure: float, likely: float):
        """Per text, {item: (cosine, common share, answer share)} of the items that it holds."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for t, i, low in self.possible(texts).tolist():
            item, n, text = self.items[i], len(self.items[i].words), texts[t]
            if out[t].get(i, (0, 0, 0))[1] >= sure:
                continue
            high = low + BLOCK - 1 + item.reach
            part = text[low:high].tolist()
            there = set(part)
            # what is common to all of it bounds what is common to a place
            if sum(map(there.__contains__, item.words.tolist())) < likely * n:
                continue
            answers, m = bit_masks(item.answer), len(item.answer)
            most = common_length(item.masks, n, part) / n
            if most < likely or most < sure and common_length(answers, m, part) / m < sure:
                continue
            pairs = self.closeness(text, i, low, high)
            near = [begin - item.slack for close, begin in pairs if close >= cosine]
            # a place may as well begin with its first common word
            every = [low + k for k, w in enumerate(part[:BLOCK]) if w in item.masks or w in answers]
            for begin in dict.fromkeys([*near, *every]):
                place = text[max(0, begin) : max(0, begin + item.reach)].tolist()
                share = common_length(item.masks, n, place) / n
                if share < likely or share <= out[t].get(i, (0, 0, 0))[1]:
                    continue
                answer = common_length(answers, m, place) / m
                if share >= sure or answer >= sure:
                    out[t][i] = pairs[0][0], share, answer
                if share >= sure:
                    break
        return out


def _passages(words: np.ndarray, stride: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, max(len(words) - PASSAGE, 0) + stride, stride):
        if start == 0 or start < len(words) - PASSAGE + stride:
            at = max(0, min(start, len(words) - PASSAGE))
            yield at, words[at : at + PASSAGE]


def singular_vectors(passages: DataFrame, width: int) -> np.ndarray:
    """Leading right singular vectors of the rows (slots, weights), width x rank.

    Randomised: a Gaussian start, then rounds of A'(A Q), each summed over tasks, with an
    orthogonal basis in between; the last round's small matrix is decomposed.
    """
    rank = min(RANK + OVERSAMPLE, width)
    spark = passages.sparkSession
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((width, rank)))[0]
    for _ in range(ROUNDS + 1):
        the_basis = shared(spark, q)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = the_basis()  # noqa: B023
            total = np.zeros_like(base)
            for batch in batches:
                for slots, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, w = np.array(slots, np.int64), np.array(weights)
                    np.add.at(total, at, np.outer(w, w @ base[at]))
            yield _in_chunks(total)

        sums = _summed(map_arrow(passages, project, "chunk int, block binary"))
        z = np.concatenate([sums[c].reshape(-1, rank) for c in range(CHUNKS)]) if sums else np.zeros_like(q)
        last, q = q, np.linalg.qr(z)[0]
    values, vectors = np.linalg.eigh(last.T @ z)
    keep = np.argsort(-values)[: min(RANK, rank)]
    return last @ vectors[:, keep]


def build_index(docs: DataFrame, items: list, frequency: np.ndarray, n_docs: int, likely: float, fit_documents: int) -> Index | None:
    """The index over ``items`` (rows with item_id and text); all their words are indexed.

    A place that has ``likely`` of an item's words lacks at most the others, so of its rarest words,
    a quarter of the item more than may be lacking, it has a quarter of the item at least. The SVD is fitted on all item passages and the passages of about ``fit_documents`` documents,
    chosen by their ids' hash; frequencies come from all documents.
    """
    spark = docs.sparkSession
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    own = []
    for r in items:
        words, answer = terms(r["text"] or ""), terms(answer_of(r["text"] or ""))
        if len(words):
            own.append(Item(r["item_id"], words, answer if len(answer) else words, bit_masks(words)))
    if not own:
        return None
    indexed = np.unique(np.concatenate([item.words for item in own]))
    slot = np.full(FEATURES, -1, np.int64)
    slot[indexed] = np.arange(len(indexed))
    asked, asking, least = [], [], []
    for i, item in enumerate(own):
        n = len(item.words)
        lacking = n - next(c for c in range(n + 1) if c / n >= likely)
        quarter = min(max(1, n // 4), n - lacking)
        rare = item.words[np.argsort(frequency[item.words], kind="stable")][: lacking + quarter]
        asked.append(slot[rare])
        asking.append(np.full(len(rare), i))
        least.append(quarter)
    asked, asking = np.concatenate(asked), np.concatenate(asking)
    posted = np.r_[0, np.cumsum(np.bincount(asked, minlength=len(indexed)))]
    asking = asking[np.argsort(asked, kind="stable")]

    def row(words: np.ndarray) -> tuple[list[int], list[float]]:
        inside = words[slot[words] >= 0]
        f, times = np.unique(inside, return_counts=True)
        return slot[f].tolist(), (times * idf[f]).tolist()

    cut = [(i, at, *row(w)) for i, item in enumerate(own) for at, w in _passages(item.words, ITEM_STRIDE)]
    schema = "slots array<int>, weights array<double>"
    of_items = spark.createDataFrame([(s, w) for _, _, s, w in cut], schema)
    every = max(1, n_docs // fit_documents)
    sample = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(every)) == 0).select("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                row(w) for t in batch.column(0)
                for _, w in _passages(terms(t.as_py() or ""), PASSAGE)
            ]
            made = [m for m in made if m[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float64()))],
                ["slots", "weights"],
            )

    matrix = stored(of_items.union(map_arrow(sample, rows, schema)))
    basis = singular_vectors(matrix, len(indexed))
    latent = np.array([np.array(w) @ basis[s] for _, _, s, w in cut])
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
    begins = np.searchsorted([c[0] for c in cut], np.arange(len(own) + 1))
    return Index(own, idf, slot, basis, latent, np.array([c[1] for c in cut]), begins, posted, asking, np.array(least))


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, sure: float = 0.8,
    likely: float = 0.6, fit_documents: int = 2000, items_at_once: int = 20_000,
) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, cosine, common, answer), one per benchmark
    item that the whole text holds; empty for clean documents.

    An item is held if its longest common subsequence with some place has at least ``sure`` of its
    words, or at least ``likely`` of them and at least ``sure`` of its answer's (a paraphrase); a
    place is any stretch of the text one and a half times as long as the item, and 16 words more.
    ``cosine`` says which places are looked at first; none is left out. The column is the best there.
    A null or empty text holds nothing, a null or empty item is held by nothing; null ids are
    carried. Rows stand for themselves; other columns are kept, one named leaks is replaced. An
    empty table gives no rows. Items are indexed ``items_at_once``; each such slice is one pass over
    the documents, so a large benchmark takes more passes, not more memory.
    """
    docs = docs.drop("leaks")
    found = "array<struct<item_id:long,cosine:double,common:double,answer:double>>"
    out = docs.withColumn("leaks", F.array().cast(found))
    n_items, n_docs = benchmark.count(), docs.count()
    if not n_items or not n_docs:
        return out
    frequency = document_frequencies(docs)
    slices = -(-n_items // items_at_once)
    slice_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())]))
    for i in range(slices):
        items = benchmark.where(slice_of == i).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()
        index = build_index(docs, items, frequency, n_docs, likely, fit_documents)
        if index is None:
            continue
        the_index = shared(docs.sparkSession, index)

        def search(batches: Iterator[pa.RecordBatch], the_index=the_index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [terms(text.as_py() or "") for text in batch.column(at)]
                leaks = []
                for hits, before in zip(the_index().hits(own, cosine, sure, likely), batch.column(batch.num_columns - 1)):
                    new = [
                        {"item_id": the_index().items[k].item_id, "cosine": c, "common": s, "answer": a}
                        for k, (c, s, a) in sorted(hits.items())
                    ]
                    leaks.append([*(before.as_py() or []), *new])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, kind)], batch.schema.names)

        out = out.mapInArrow(search, out.schema)
    return out
