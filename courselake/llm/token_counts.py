"""Token counts of whole texts by a public tokenizer, huge documents by overlapping chunks."""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courselake.llm.common import map_arrow

# Boundaries at which the splitter of byte-level tokenizers always cuts, whatever stands around: before
# a single white space character between two visible ones (which a space begins the next word with),
# and between letters, digits and other visible characters. A contraction's mark is itself such a
# boundary, and one inside it is none, so a place after one is left out; so is what can be part of a
# special token's string.
SPLITTERS = {
    # fixed value: the kind of pre-tokenizer and the pattern of boundaries that holds for it
    "ByteLevel": re.compile(
        r"(?<=\S)(?=[ \t\n\r]\S)|(?<=[A-Za-z\u4e00-\u9fff])(?=[0-9,.;:!?\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f])"
        r"|(?<=[\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f])(?=[A-Za-z0-9\u4e00-\u9fff])"
    )
}


def boundaries(tokenizer) -> re.Pattern | None:
    """The places where the tokenizer's own splitter always cuts; None for a splitter that is not
    known, whose texts are encoded whole."""
    splitter = tokenizer.pre_tokenizer
    kind = json.loads(splitter.__getstate__()) if splitter is not None else {}
    known = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
    plain = tokenizer.normalizer is None and all(
        t.content.isascii() and not (t.lstrip or t.rstrip or t.single_word or re.search(r"[\s0-9,.;:!?]", t.content))
        for t in tokenizer.get_added_tokens_decoder().values()
    )
    return SPLITTERS["ByteLevel"] if known and plain else None


def resynchronised_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, encoded in chunks that overlap.

    Each chunk is encoded with offsets. Inside the overlap, a stable boundary (see SPLITTERS) at
    which tokens of both encodings start is where the earlier chunk's tokens end and the later
    one's begin. Where there is none, the overlap is doubled; once it is as long as the chunk,
    the earlier chunk is encoded anew at twice its length, so that a text without any boundary
    costs about two encodings of it and not one per chunk.
    """
    stable = boundaries(tokenizer)
    if stable is None:
        return len(tokenizer.encode(text, add_special_tokens=False))
    total, start, end = 0, 0, min(len(text), chunk)
    starts = _starts(tokenizer, text, start, end)
    since = start  # the earlier chunk's tokens count from here
    while end < len(text):
        width = overlap
        while True:
            begin = end - width
            if begin <= since:
                end = min(len(text), start + 2 * (end - start))
                starts = _starts(tokenizer, text, start, end)
                break
            upto = min(len(text), begin + chunk + width)
            if not stable.search(text, begin + 1, end - 1):
                width *= 2
                continue
            later = _starts(tokenizer, text, begin, upto)
            at = _common(stable, text, starts, later, begin, end)
            if at is not None:
                total += bisect_left(starts, at) - bisect_left(starts, since)
                starts, start, since, end = later, begin, at, upto
                break
            width *= 2
    return total + len(starts) - bisect_left(starts, since)


def _starts(tokenizer, text: str, start: int, end: int) -> list[int]:
    """Where each token of text[start:end] starts, as places in ``text``."""
    encoded = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [start + a for a, _ in encoded.offsets]


def _common(
    stable: re.Pattern, text: str, earlier: list[int], later: list[int], begin: int, end: int
) -> int | None:
    """The last stable boundary in the overlap at which both encodings start a token."""
    both = set(earlier[bisect_left(earlier, begin) :]) & set(later[: bisect_left(later, end)])
    for match in reversed(list(stable.finditer(text, begin + 1, end - 1))):
        if match.start() in both:
            return match.start()
    return None


# Where pieces are cut: before such a space, and between a letter or digit and one of these
# marks, which are no part of a word, of a contraction or of a special token's string.
PIECE = re.compile(r"(?<=\S)(?= \S)|(?<=[^\W_])(?=[,.;:!?])")


class PieceCounts(dict):
    """Pieces of text between stable boundaries, to their number of tokens."""

    def __init__(self, tokenizer, most: int = 400_000):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.cut = boundaries(tokenizer) is not None

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the library encodes each new piece once."""
        cut = [PIECE.split(text) if self.cut else [text] for text in texts]
        ends = [pieces.pop() for pieces in cut]  # these alone may end in white space
        new = {p for pieces in cut for p in pieces if p not in self}
        if len(self) + len(new) > self.most:
            self.clear()
            new = {p for pieces in cut for p in pieces}
        self._learn([p for p in new if p[0] == " " and p[1:2].strip()])
        for p, n in self._each([p for p in new if p not in self]):
            self[p] = n
        return [
            sum(map(self.__getitem__, pieces)) + n for pieces, (_, n) in zip(cut, self._each(ends))
        ]

    def _each(self, pieces: list[str]) -> list[tuple[str, int]]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [(p, len(e)) for p, e in zip(pieces, encoded)]

    def _learn(self, pieces: list[str], together: int = 2048) -> None:
        """Counts pieces that begin with the space of a boundary, many in one text."""
        for at in range(0, len(pieces), together):
            part = pieces[at : at + together]
            begins = np.cumsum([0, *map(len, part[:-1])])
            encoded = self.tokenizer.encode("".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded))
            owner = np.searchsorted(begins, starts, "right") - 1
            self.update(zip(part, np.bincount(owner, minlength=len(part)).tolist()))


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = 32768, overlap: int = 256
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the tokenizer gives them.

    No begin, end or added tokens, no truncation or padding; a special token's string inside a
    text is what the library makes of it by default. Texts above ``chunk`` characters are
    encoded in overlapping chunks; shorter ones in pieces cut at the same stable boundaries, so
    that a piece which recurs is encoded once a task. A null or empty text has 0 tokens. Rows
    stand for themselves (null ids and repeated rows too); extra columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        # one tokenizer and its known pieces for the life of the Python worker
        kept = tokenizers.__dict__.setdefault("_known_pieces", {})
        if tokenizer_path not in kept:
            tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            kept[tokenizer_path] = PieceCounts(tokenizer)
        known = kept[tokenizer_path]
        tokenizer = known.tokenizer
        for batch in batches:
            whole = [t or "" for t in batch.column(1).to_pylist()]
            short = known.totals([t if len(t) <= chunk else "" for t in whole])
            n = [
                s if len(t) <= chunk else resynchronised_count(tokenizer, t, chunk, overlap)
                for t, s in zip(whole, short)
            ]
            size = [len(t.encode()) for t in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        count, "doc_id long, n_bytes long, n_tokens long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
