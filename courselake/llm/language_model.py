"""Corpus language model: smoothed n-grams as a weighted backoff automaton.

States are the contexts that learned texts hold: the empty one (the root), and sequences of up to
order - 1 tokens, which may begin with the start of a text. A state's arcs are the tokens seen
after it, weighted with their smoothed probability; an arc leads to the longest context that the
automaton keeps of what was read. A state has a failure arc to the context without its first token,
with a weight of its own; the root has an arc for every token. Scoring is one walk from left to
right, which carries the state, takes failure arcs until the token has an arc, and adds log weights.

The automaton grows with the corpus, so no task holds it. Texts are packed in batches once. A batch
asks for the part that it needs: the counts of its distinct n-grams, in blocks by hash range; one
group per range sums the blocks of all batches and answers each. The batch then builds its part of
the automaton and walks its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.llm.common import (
    learns, map_arrow, scramble, shuffle_partitions, stored, texts, word_hashes,
)
from courselake.llm.packing import bucket_edges, pack, pack_sorted, unpack, unpack_sorted

BATCH_TOKENS = 1_000_000
BATCHES_A_BUCKET = 4
# Hashes that stand for the end of a text and for its start.
END, START = np.uint64(0), np.uint64(1)
SEGMENT = 2048


def _batches(docs: DataFrame) -> DataFrame:
    """Texts packed as token numbers, about BATCH_TOKENS together: each row has the documents' ids,
    whether they are learned from, their lengths, tokens, and the sorted hashes of its words. A
    text's tokens are its start, its words and its end."""

    def flush(name: str, ids: list, learned: list, parts: list) -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        lengths = np.array([len(p) for p in parts], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([pack(np.array(learned, np.uint8))], pa.binary()),
                pa.array([pack(lengths)], pa.binary()),
                pa.array([pack(tokens.astype(np.uint32))], pa.binary()),
                pa.array([pack_sorted(words)], pa.binary()),
            ],
            ["batch", "ids", "learned", "lengths", "tokens", "words"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        learned: list = []
        parts: list = []
        for batch in batches:
            for doc_id, learn, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                ids.append(doc_id)
                learned.append(learn)
                parts.append(np.concatenate([[START], word_hashes(data.lower()), [END]]))
                size += len(parts[-1])
                if size >= BATCH_TOKENS:
                    yield flush(f"{task}-{n}", ids, learned, parts)
                    n, size, ids, learned, parts = n + 1, 0, [], [], []
        if ids:
            yield flush(f"{task}-{n}", ids, learned, parts)

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), learns(F.col("doc_id"), 5, 1), "text"), encode,
        "batch string, ids array<long>, learned binary, lengths binary, tokens binary, words binary",
    )


@dataclass
class _Grams:
    """A batch's distinct n-grams of one length: sorted keys; where n-grams end in the texts, which
    key each is, and the place of the first of each key. ``of`` has the key of each place, else -1."""

    keys: np.ndarray
    places: np.ndarray
    which: np.ndarray
    first: np.ndarray
    of: np.ndarray


class _Texts:
    """A batch's texts as token numbers, one after the other."""

    def __init__(self, learned: bytes, lengths: bytes, tokens: bytes, words: bytes):
        self.lengths = unpack(lengths, np.int64)
        self.tokens = unpack(tokens, np.uint32).astype(np.int64)
        self.words = unpack_sorted(words)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.inside = np.arange(len(self.tokens)) - np.repeat(self.begins, self.lengths)
        self.text_learned = unpack(learned, np.uint8).astype(bool)
        self.learned = np.repeat(self.text_learned, self.lengths)

    def grams(self, order: int) -> list[_Grams]:
        """The n-grams of each length to ``order``. The lowest bit of a key of two or more
        tokens says whether it ends with the end of a text, so that it is no context."""
        everywhere = np.arange(len(self.tokens))
        first = np.zeros(len(self.words), np.int64)
        first[self.tokens[::-1]] = everywhere[::-1]
        out = [_Grams(self.words, everywhere, self.tokens, first, self.tokens)]
        word = self.words[self.tokens]
        turned, hashed = (word << np.uint64(23)) | (word >> np.uint64(41)), word
        for n in range(2, order + 1):
            before = np.r_[np.uint64(0), hashed[:-1]]
            hashed = scramble(before * np.uint64(0x9E3779B97F4A7C15) ^ turned)
            places = np.flatnonzero(self.inside >= n - 1)
            marked = (hashed[places] & ~np.uint64(1)) | (word[places] == END)
            keys, at, which = np.unique(marked, return_index=True, return_inverse=True)
            of = np.full(len(self.tokens), -1)
            of[places] = which
            out.append(_Grams(keys, places, which, places[at], of))
        return out


ASKED = "bucket int, batch string, keys binary, counts binary"


def _asks(packed: DataFrame, buckets: int, n: int) -> DataFrame:
    """Per batch and hash range: sorted keys of its n-grams, and how often its learned texts have each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                held = _Texts(row["learned"], row["lengths"], row["tokens"], row["words"])
                grams = held.grams(n)[-1]
                counts = np.bincount(
                    grams.which[held.learned[grams.places]], minlength=len(grams.keys)
                ).astype(np.uint32)
                edges = bucket_edges(grams.keys, 64, buckets)
                full = [i for i in range(buckets) if edges[i] < edges[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()), pa.array([row["batch"]] * len(full)),
                        pa.array([pack_sorted(grams.keys[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
                        pa.array([pack(counts[edges[i] : edges[i + 1]]) for i in full], pa.binary()),
                    ],
                    ["bucket", "batch", "keys", "counts"],
                )

    return map_arrow(packed.select("batch", "learned", "lengths", "tokens", "words"), ask, ASKED)


ANSWERED = "batch string, bucket int, counts binary, total long, kinds long, once long, contexts array<long>, passes array<long>"


def _answers(asked: DataFrame, n: int) -> DataFrame:
    """Corpus counts of the keys that each batch asked for, in its order; and one row per range,
    without batch, with sums: of all tokens, kinds and kinds seen once, and by the power of two of
    their count, how many n-grams can be contexts and how often these occur."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [unpack_sorted(k) for k in pdf["keys"]]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]])
        sums = np.bincount(at, weights=counts).astype(np.int64)
        each = np.split(at, np.cumsum([len(k) for k in own])[:-1])
        real = sums[keys != START] if n == 1 else sums
        context = sums[(keys != END if n == 1 else (keys & np.uint64(1)) == 0) & (sums > 0)]
        power = np.frexp(context.astype(np.float64))[1] - 1
        own_sums = {
            "total": int(real.sum()), "kinds": int((real > 0).sum()), "once": int((real == 1).sum()),
            "contexts": np.bincount(power, minlength=64).tolist(),
            "passes": np.bincount(power, weights=context, minlength=64).astype(np.int64).tolist(),
        }
        answers = len(pdf)
        return pd.DataFrame(
            {
                "batch": [*pdf["batch"], None],
                "bucket": int(pdf["bucket"].iloc[0]),
                "counts": [*(pack(sums[i]) for i in each), None],
                **{k: [*[[] if isinstance(v, list) else 0] * answers, v] for k, v in own_sums.items()},
            }
        )

    return asked.groupBy("bucket").applyInPandas(answer, ANSWERED)


def failure_strength(contexts: list[int], passes: list[int], once: int) -> float:
    """The strength s for which contexts seen c times, which fail with weight s / (c + s), fail as
    often as arcs were passed once only: the Good-Turing estimate of meeting an unseen arc. Contexts
    come by the power of two of c, each with the mean c of its power. Between 0.001 and a million."""
    number, total = np.array(contexts, float), np.array(passes, float)
    number, total = number[number > 0], total[number > 0]
    if not len(number):
        return 1.0
    low, high = 1e-3, 1e6
    for _ in range(60):
        s = (low * high) ** 0.5
        low, high = (s, high) if (total * s / (total / number + s)).sum() < once else (low, s)
    return (low * high) ** 0.5


class _Automaton:
    """The part of the automaton that a batch's texts can reach.

    States are numbered, the root is 0. Arcs are sorted by (state, token), with the logarithm of
    their weight and the state they lead to; ``failure`` and ``failure_log`` belong to states.
    """

    def __init__(self, held: _Texts, grams: list[_Grams], counts: list[np.ndarray], base: np.ndarray, strengths: list[float]):
        self.held, self.order = held, len(grams)
        begun = held.inside[grams[0].first] == 0  # the token that is the start
        state_of, fails, fail_logs, states = [], [[0]], [[0.0]], 1
        for k in range(1, self.order):
            g, c = grams[k - 1], counts[k - 1]
            ends = g.keys == END if k == 1 else (g.keys & np.uint64(1)) == 1
            kept = (c > 0) & ~ends
            number = np.full(len(g.keys), -1)
            number[kept] = states + np.arange(kept.sum())
            states += int(kept.sum())
            fails.append(np.zeros(kept.sum(), int) if k == 1 else state_of[-1][grams[k - 2].of[g.first[kept]]])
            fail_logs.append(np.log10(strengths[k - 1] / (c[kept] + strengths[k - 1])))
            state_of.append(number)
        self.failure, self.failure_log = (np.concatenate(x) for x in (fails, fail_logs))
        self.start = int(state_of[0][begun][0]) if self.order > 1 and begun.any() else 0

        root = np.zeros(len(held.words), int) if self.order == 1 else np.maximum(state_of[0], 0)
        sources, tokens, weights, targets = [np.zeros((~begun).sum(), int)], [np.flatnonzero(~begun)], [base[~begun]], [root[~begun]]
        shorter = base  # the weight of each shorter n-gram's arc
        for n in range(2, self.order + 1):
            g, c, s = grams[n - 1], counts[n - 1], strengths[n - 2]
            kept = c > 0
            last = g.first[kept]
            context = grams[n - 2].of[last - 1]
            weight = np.zeros(len(c))
            weight[kept] = (c[kept] + s * shorter[grams[n - 2].of[last]]) / (counts[n - 2][context] + s)
            reached = state_of[n - 1][kept] if n < self.order else state_of[n - 2][grams[n - 2].of[last]]
            sources.append(state_of[n - 2][context])
            tokens.append(held.tokens[last])
            weights.append(weight[kept])
            targets.append(np.maximum(reached, 0))  # nothing is read after an end
            shorter = weight
        arcs = np.concatenate(sources) * len(held.words) + np.concatenate(tokens)
        by = np.argsort(arcs)
        self.arcs, self.target = arcs[by], np.concatenate(targets)[by]
        self.arc_log = np.log10(np.concatenate(weights))[by]

    def _read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token each, and the log weights of the arcs taken."""
        log = np.zeros(len(state))
        todo, at = np.arange(len(state)), state.copy()
        place = np.empty(len(state), np.int64)
        while len(todo):
            key = at[todo] * len(self.held.words) + token[todo]
            found = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[found] == key
            place[todo[hit]] = found[hit]
            todo = todo[~hit]
            log[todo] += self.failure_log[at[todo]]
            at[todo] = self.failure[at[todo]]
        return self.target[place], log + self.arc_log[place]

    def scores(self) -> np.ndarray:
        """The log10 probability of each text: walks of all texts side by side.

        A long text is walked in segments. A segment first reads the order - 1 tokens before it
        from the root without scoring them, after which the state is that of the whole walk, as a
        state is the longest kept context of at most that many tokens.
        """
        held, back = self.held, self.order - 1
        pieces = -(-(held.lengths - 1) // SEGMENT)  # the start itself is not read
        text = np.repeat(np.arange(len(pieces)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = held.begins[text] + 1 + nth * SEGMENT
        end = np.minimum(begin + SEGMENT, held.begins[text] + held.lengths[text])
        warm = np.where(nth > 0, np.minimum(back, nth * SEGMENT), 0)
        reads = end - begin + warm
        by = np.argsort(-reads, kind="stable")
        at, warm, reads = (begin - warm)[by], warm[by], reads[by]
        state, total = np.where(nth[by] > 0, 0, self.start), np.zeros(len(by))
        for t in range(int(reads[0]) if len(reads) else 0):
            n = np.searchsorted(-reads, -t)  # those that read more than t tokens
            state[:n], log = self._read(state[:n], held.tokens[at[:n] + t])
            total[:n] += np.where(warm[:n] <= t, log, 0.0)
        return np.bincount(text[by], weights=total, minlength=len(pieces))


def lm_scores(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the words of the text with A-Z in lower case, then one end. With c counts over the
    learned texts (crc32 of the id mod 5 is not 1), N their tokens and V their distinct tokens,
    base_score adds log10 of b(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), the weights of the root's arcs.
    The state of a context h with n - 1 tokens has the failure weight s / (c(h) + s), and the arc of a
    token w seen after it weighs (c(hw) + s p(w | h')) / (c(h) + s), with h' its failure state and s
    the strength of length n (see ``failure_strength``). So a state's probabilities sum to 1.
    ``order`` is the longest n-gram; with 1 the score is the base.

    A null or empty text is one end token; a null id counts as learned. Repeated rows are texts of
    their own; extra columns are not read. An empty table gives no rows. Without any learned text
    b is 1 for every token and scores are 0. Words and n-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    packed = stored(_batches(docs))
    buckets = max(2 * shuffle_partitions(spark), packed.count() // BATCHES_A_BUCKET)
    answers = [stored(_answers(_asks(packed, buckets, n), n)) for n in range(1, order + 1)]
    sums = []
    for a in answers:
        own = a.where("batch is null")
        total, kinds, once = (x or 0 for x in own.agg(F.sum("total"), F.sum("kinds"), F.sum("once")).first())
        spread = own.select(F.posexplode(F.arrays_zip("contexts", "passes"))).groupBy("pos").agg(
            F.sum("col.contexts"), F.sum("col.passes")
        ).orderBy("pos").collect()
        sums.append((total, kinds, once, [r[1] for r in spread], [r[2] for r in spread]))
    n, v = sums[0][:2]
    strengths = [failure_strength(*shorter[3:], longer[2]) for shorter, longer in zip(sums, sums[1:])]
    told = None
    for kind, a in enumerate(answers):
        part = a.where("batch is not null").select("batch", F.lit(kind).alias("kind"), "bucket", "counts")
        told = part if told is None else told.union(part)
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

    def walk(key, texts_of: pd.DataFrame, told_of: pd.DataFrame) -> pd.DataFrame:
        row = texts_of.iloc[0]
        held = _Texts(row["learned"], row["lengths"], row["tokens"], row["words"])
        told_of = told_of.sort_values(["kind", "bucket"])
        counts = [
            np.concatenate([unpack(c, np.int64) for c in told_of["counts"][told_of["kind"] == k]] or [np.zeros(0, np.int64)])
            for k in range(order)
        ]
        base = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        read = np.where(held.inside > 0, np.log10(base)[held.tokens], 0.0)  # the start is not read
        known = (held.inside > 0) & (counts[0][held.tokens] > 0)
        ids = pd.array([None if i is None or i != i else int(i) for i in row["ids"]], "Int64")
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": ~held.text_learned,
                "n_tokens": held.lengths - 1,
                "n_known": np.add.reduceat(known.astype(np.int64), held.begins),
                "train_tokens": n,
                "base_score": np.add.reduceat(read, held.begins),
                "score": _Automaton(held, held.grams(order), counts, base, strengths).scores(),
            }
        )

    return packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(walk, schema)
