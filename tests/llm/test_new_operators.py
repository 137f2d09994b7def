"""Repeated strings, hard negatives and the conversation trie against brute force, on odd small tables."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courselake.llm import conversation_trie as trie
from courselake.llm import hard_negatives as mining
from courselake.llm import repeats

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# ---- 11


def removed_by_hand(docs: list[bytes], length: int) -> list[tuple]:
    times = collections.Counter(d[p : p + length] for d in docs for p in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if times[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def odd_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = prose(60)
    texts = [prose(r.randint(0, 200)) for _ in range(25)]
    texts += [prose(20) + line[: r.randint(80, 300)] + prose(20) for _ in range(25)]  # a common line, cut off anywhere
    texts += [line[k:] + prose(5) for k in (0, 1, 7, 30)]
    texts += [texts[3], texts[3], texts[30] + "!", "?" + texts[31], texts[5] * 2]
    texts += [None, "", "x", "x" * 199, "x" * 200, "x" * 700, "ab" * 400, line * 3, prose(9000), prose(3000) + line]
    return texts


@pytest.mark.parametrize("length,most", [(200, 50_000), (40, 50_000), (40, 3), (9, 50_000)])
def test_repeated_spans_are_those_found_by_hand(spark, length, most):
    texts = odd_texts()
    rows = [(None if i == 7 else i, t, "own", 1) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (9, "another text", "own", 2)]  # a row that repeats, an id that repeats
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(3)
    got = repeats.repeated_spans(docs, length, bucket_triggers=500, batch_bytes=9000, most_contexts=most)
    expected = removed_by_hand([(t or "").encode() for _, t, *_ in rows], length)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect())
    assert found == sorted((-1 if row[0] is None else row[0], *e) for row, e in zip(rows, expected))
    for r in got.collect():
        assert sum(e - b for b, e in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_no_documents_have_no_spans(spark):
    assert repeats.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_string_has_one_trigger_at_a_distance_its_content_decides():
    r = random.Random(8)
    data = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 39, 40, 41, 500, 3 * repeats.STEP)] + [b"z" * 3000]
    owner, place, first, final, *_ = repeats.triggers(data, 40, 21)
    for i, text in enumerate(data):
        mine = owner == i
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[mine], final[mine])] or [np.zeros(0, int)])
        assert starts.tolist() == list(range(max(0, len(text) - 39)))
        at = np.repeat(place[mine], final[mine] - first[mine] + 1) - starts
        assert ((at >= 0) & (at < 21)).all()
        distance = {}
        for s, x in zip(starts.tolist(), at.tolist()):
            assert distance.setdefault(text[s : s + 40], x) == x


# ---- 12


def negatives_by_hand(rows, modulus, positives, negatives, low, high):
    vectors = [(i, str(label), np.floor(256 * np.array(v, float)).astype(int)) for i, label, v in rows]
    width = max(len(v) for *_, v in vectors)
    vectors = [(i, label, np.r_[v, np.zeros(width - len(v), int)]) for i, label, v in vectors]
    out = []
    for a, (anchor, label, v) in enumerate(vectors):
        if anchor % modulus:
            continue
        scored = sorted((-int(v @ w), i, l) for b, (i, l, w) in enumerate(vectors) if b != a)
        same = [(i, -s) for s, i, l in scored if l == label][:positives]
        for p, score in same:
            inside = [(i, -s) for s, i, l in scored if l != label and low * score <= -100 * s <= high * score]
            out += [(anchor, p, k + 1, i, score, s) for k, (i, s) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(n, width, seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(width)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = centres[i % 5]
        rows.append((i, r.choice("abc"), [x + r.gauss(0, 0.1) for x in c]))
    common = [0.1] * width
    rows += [(n + i, "a" if i % 3 else "b", common) for i in range(60)]  # a large group of equal vectors
    rows += [rows[10], rows[10], (10, "c", rows[11][2]), (0, "a", [-x for x in rows[0][2]]), (20, "c", [0.0] * width)]
    rows += [(30, "zz", rows[30][2]), (40, "b", rows[40][2][:3]), (50, "a", [])]
    return rows


@pytest.mark.parametrize("width,options", [(8, {}), (7, {"cell_rows": 8, "part_rows": 4, "seed_rows": 16}), (2, {"cell_rows": 4, "seed_rows": 1})])
def test_hard_negatives_are_those_found_by_hand(spark, width, options):
    rows = vectors(150, width, 3 + width)
    odd = [(None, "a", rows[0][2]), (10, None, rows[0][2]), (10, "a", None), (20, "a", [None] * width), (20, "a", [float("nan")] * width), (20, "a", [float("inf")] * width)]
    table = spark.createDataFrame([(*r, 5) for r in rows + odd], "vec_id long, label string, embedding array<double>, score int").repartition(3)
    got = mining.hard_negatives(table, 10, 5, 3, 50, 95, **options).collect()
    assert sorted(tuple(r) for r in got) == negatives_by_hand(rows, 10, 5, 3, 50, 95)
    assert mining.hard_negatives(table.limit(0)).count() == 0
    assert mining.hard_negatives(table.where("label is null")).count() == 0


def test_hard_negatives_meet_their_cells_in_every_partition(spark):
    """Adaptive merging puts all groups of a small table into one partition, where any two keys meet."""
    r = random.Random(8)
    rows = [(i, r.choice("abc"), [r.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    told = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in rows]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = mining.hard_negatives(table, 10, cell_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(tuple(r) for r in got) == negatives_by_hand(told, 10, 5, 3, 50, 95)


def test_cells_come_in_falling_order_of_their_bounds():
    r = np.random.RandomState(2)
    points = r.normal(size=(400, 6))
    index = mining.MultiIndex((mining.codebook(points[:, :3], 6), mining.codebook(points[:, 3:], 6)))
    i, j = mining.nearest(points[:, :3], index.books[0]), mining.nearest(points[:, 3:], index.books[1])
    for k in range(6):
        index.radii[0][k] = np.linalg.norm(points[i == k, :3] - index.books[0][k], axis=1).max(initial=0)
        index.radii[1][k] = np.linalg.norm(points[j == k, 3:] - index.books[1][k], axis=1).max(initial=0)
    np.add.at(index.count, (i, j), 1)
    query = r.normal(size=6)
    cells = list(index.cells(*index.bounds(query)[:2]))
    bounds = [b for b, *_ in cells]
    assert bounds == sorted(bounds, reverse=True)
    assert sorted((a, b) for _, a, b in cells) == sorted(set(zip(i.tolist(), j.tolist())))
    for bound, a, b in cells:
        assert (points[(i == a) & (j == b)] @ query).max() <= bound


# ---- 13


def trie_by_hand(rows, rebuild=True):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (turns.get(c - c % 100, [])[:h] + turns[c][h:]) if rebuild else turns[c]
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else -1
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth int"


def got_trie(spark, rows):
    df = spark.createDataFrame([(*r, 3) for r in rows], TURNS).repartition(3)
    out = trie.spliced_trie(df).select(F.coalesce(F.col("parent_conv_id"), F.lit(-1)).alias("parent_conv_id"), *[c for c in COLUMNS if c != "parent_conv_id"])
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


def conversations():
    r = random.Random(6)
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(205, 215), 1000]:
        rows += [(c, k, r.choice(["user", "assistant"]), r.choice(["a", "b", "é" * 5])) for k in range(r.choice([1, 2, 3, 5, 8, 9]))]
    rows += [(210, k, "user", "same") for k in range(20, 57)] + [(100, k, "user", "same") for k in range(20, 90)]  # long ones
    rows += [(1001, None, "user", "first"), (1001, 0, None, None), (1001, None, None, "x"), (None, 0, "user", "no id")]
    rows += [(c, k, "user", "copied") for c in range(300, 340) for k in range(7)]  # a large group of equal ones
    return rows + [rows[3], rows[3]]


def test_trie_is_that_built_by_hand(spark):
    rows = conversations()
    assert got_trie(spark, rows) == trie_by_hand(rows)


def test_tries_of_one_turn_of_none_and_of_no_conversations(spark):
    assert got_trie(spark, []) == [] and got_trie(spark, [(None, 0, "user", "x")]) == []
    short = [(c, 0, "user", "hi") for c in (101, 102, 105, 200, 900)]
    assert got_trie(spark, short) == trie_by_hand(short)
    absent = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0][:5]
    gone = [(c, 0, "user", "hi") for c in absent]
    assert got_trie(spark, gone) == trie_by_hand(gone) and len(trie_by_hand(gone)) == 1


def test_digests_of_ends_span_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 10)
    ends = spark.createDataFrame([(f"n{c % 3}", c) for c in range(-5, 400)], "name string, conv_id long")
    got = {r["name"]: r["ends_sha256"] for r in trie.ends_digests(ends).collect()}
    for k in range(3):
        ids = ",".join(str(c) for c in range(-5, 400) if f"n{c % 3}" == f"n{k}")
        assert got[f"n{k}"] == hashlib.sha256(ids.encode()).hexdigest()


# ---- SQL


@pytest.mark.parametrize("name", ["op2_curriculum", "op7_top_inner_products", "op12_hard_negatives", "op13_conversation_trie"])
def test_corpus_query_equals_sql(spark, name):
    import glob

    import duckdb
    from test_oracle import rows

    from courselake.llm.oracle import ORACLES
    from courselake.llm.queries import QUERIES

    duck = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert name in ORACLES
    actual, expected = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(actual.columns) == sorted(expected.columns)
    assert rows(actual) == rows(expected)
