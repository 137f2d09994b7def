"""The corpus operators against brute force, on small tables with nulls, ties and repeats."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from courselake.llm import decontamination, ngram_join, toxicity as tox
from courselake.llm.curriculum import curriculum, in_training_order
from courselake.llm.language_model import lm_scores
from courselake.llm.preferences import pair_by_number, pair_by_reply, preference_pairs
from courselake.llm.pseudonyms import pseudonymised
from courselake.llm.sharding import histogram_shards
from courselake.llm.token_counts import PieceCounts, resynchronised_count, token_counts
from courselake.llm.topk import top_inner_products

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, node int"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(150)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents():
    """Copies, near copies, nulls, empty and very long texts, repeated rows, a hot source."""
    texts = [prose(5 + 7 * (i % 9), i) for i in range(60)]
    texts += [texts[20]] * 9 + [texts[25] + " extra", texts[26].replace(" ", "\t"), texts[26].upper()]
    texts += [None, "", " \n ", "one", "one", "Two words", "two WORDS", prose(4000, 77), prose(4000, 77) + " end", "x" * 70000]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4 if i % 2 else 0}", 1, "own", 3) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "an id is missing here", None, "src9", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- 1


def common_subsequence(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            table[j + 1], last = (last + 1 if x == y else max(table[j + 1], table[j])), table[j + 1]
    return table[-1]


def test_common_length_is_the_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(1, 40))] for _ in range(2))
        got = decontamination.common_length(decontamination.bit_masks(np.array(a)), len(a), b)
        assert got == common_subsequence(a, b)


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("klmnopqrstuvw") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(r.randint(16, 50))) + ".") for i in range(30)]
    rows, truth, fuzzy = [], set(), set()
    for i in range(200):
        text = [word() for _ in range(r.randint(0, 300))]
        if i % 5 == 0:
            item = items[i % 30]
            part = item[1].split()
            if i % 10 == 0:  # a paraphrase: every sixth word replaced
                part = [word() if k % 6 == 2 else w.upper() for k, w in enumerate(part)]
                fuzzy.add((i, item[0]))
            at = r.randint(0, len(text))
            text[at:at] = part
            truth.add((i, item[0]))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, items[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "tiny item")], "item_id long, text string")
    found = decontamination.with_leaks(docs, bench).select("doc_id", F.explode("leaks").alias("l")).collect()
    got = {(x["doc_id"], x["l"]["item_id"]) for x in found}
    assert got - {(None, 0)} <= truth and (None, 0) in got
    assert len(truth & got) >= 0.9 * len(truth) and len(fuzzy & got) >= 0.9 * len(fuzzy)
    empty = spark.createDataFrame([], bench.schema)
    assert decontamination.with_leaks(docs, empty).where(F.size("leaks") > 0).count() == 0
    assert decontamination.with_leaks(docs.limit(0), bench).count() == 0
    many = decontamination.with_leaks(docs, bench, items_at_once=7)
    assert {(x["doc_id"], x["l"]["item_id"]) for x in many.select("doc_id", F.explode("leaks").alias("l")).collect()} == got


def test_leaks_with_swapped_rare_words_are_found(spark):
    """Against brute force over every place: only common words of an item are left."""
    r = random.Random(12)
    odd = lambda: "".join(r.choice("klmnopqrstuvw") for _ in range(9))
    common = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    some = lambda: r.choice(common)
    items = []
    for i in range(12):
        words = [some() for _ in range(r.randint(15, 60))]
        for k in r.sample(range(len(words)), len(words) // 5):
            words[k] = odd()
        items.append((i, " ".join(words) + "."))
    rows = []
    for i in range(120):
        text = [some() if r.random() < 0.6 else odd() for _ in range(r.randint(0, 300))]
        if i % 2 == 0:
            own = items[i % 12][1].strip(".").split()
            lost = r.choice([0, 0, 1, 3])  # words that go with the rare ones
            kept = [odd() if len(w) == 9 else w for w in own]
            for k in r.sample(range(len(kept)), lost):
                kept[k] = odd()
            at = r.randint(0, len(text))
            text[at:at] = kept
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.with_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["l"]["item_id"]) for x in found.select("doc_id", F.explode("leaks").alias("l")).collect()}
    want = set()
    for item_id, t in items:
        item, answer = (decontamination.terms(x) for x in (t, decontamination.answer_of(t)))
        n, of_item, of_answer = len(item), decontamination.bit_masks(item), decontamination.bit_masks(answer)
        for doc_id, text in rows:
            words = decontamination.terms(text).tolist()
            for k in range(len(words)):
                place = words[k : k + n + 2 * (n // 4 + decontamination.STRIDE)]
                share = decontamination.common_length(of_item, n, place) / n
                if share >= 0.8 or share >= 0.6 and decontamination.common_length(of_answer, len(answer), place) >= 0.8 * len(answer):
                    want.add((doc_id, item_id))
    assert got == want and len(want) >= 30


# ---- 2


def test_curriculum_meets_its_targets(docs, none):
    rows = curriculum(docs).collect()
    assert len(rows) == len(documents())
    sizes = collections.Counter()
    for _, text, _, source, *_ in documents():
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, goal = sum(sizes.values()), set(order), {}
    while open_:  # share again and again
        level = (total - sum(goal.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        goal |= {s: 3 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["copies"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= 4001
    again = curriculum(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert curriculum(none).count() == 0
    assert in_training_order(curriculum(docs)).count() == len(rows)


# ---- 3


def test_pseudonyms_keep_formats_and_links(spark):
    texts = [
        "card 4041894974608795 and 4041-8949-7460-8795, ip 42.144.35.254.", "again 4041894974608795!",
        "call +1 (988) 555-2485 on 2024-02-29 or 31.12.1999", "12/31/2001 and 02/30/2001 x 1234567890123456 999.1.1.1",
        "ssn 123-45-6789 not 666-11-1111, A.b@c.example.com a.b@C.example.com", None, "", "nothing here", "1" * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r["text"] for r in pseudonymised(df).orderBy("doc_id").collect()]
    card = out[1].split()[1][:-1]
    digits = [int(c) for c in card][::-1]
    assert (sum(digits[0::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0
    assert card != "4041894974608795" and card in out[0] and f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}" in out[0]
    assert "555-2485" not in out[2] and "2024-02-29" not in out[2] and "42.144.35.254" not in out[0]
    assert "02/30/2001 x 1234567890123456 999.1.1.1" in out[3] and "12/31/2001" not in out[3]
    assert "123-45" not in out[4] and "666-11-1111" in out[4] and out[4].split()[-1] == out[4].split()[-2]
    assert out[5:] == texts[5:]
    many = spark.range(600).select(F.concat(F.lit("n "), F.format_string("1.2.3.%d", F.col("id") % 256)).alias("text"))
    assert pseudonymised(many).select("text").distinct().count() == 256


def test_numbers_with_code_one_keep_their_kind_and_stay_apart(spark):
    r = random.Random(3)
    numbers = ["+1 {:03d}-{:07d}".format(r.randrange(1000), r.randrange(10**7)) for _ in range(3000)]
    numbers += ["+1 {:03d}-{:07d}".format(a, e) for a in (0, 199, 200, 201, 999) for e in (0, 1_999_999, 2_000_000, 9_999_999)]
    numbers = sorted(set(numbers))
    from courselake.llm.pseudonyms import _phone

    df = spark.createDataFrame([(x,) for x in numbers], "t string")
    got = [x[0] for x in df.select(_phone(F.col("t"), "k")).collect()]
    kind = lambda x: x[3] in "01" or x[7] in "01"
    assert len(set(got)) == len(numbers) and [kind(x) for x in got] == [kind(x) for x in numbers]
    assert all(len(x) == len(y) and x[:3] == "+1 " for x, y in zip(got, numbers))


# ---- 4


def components(rows, width, similarity):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        k = min(width, len(words))
        sets.append({tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None:
                if both >= similarity * (len(a) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
                    links[i], links[j] = links[i] + 1, links[j] + 1
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(s), least.get(find(i)), links[i]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("width,similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_ngram_join_finds_all_components_and_links(docs, none, width, similarity):
    got = ngram_join.ngram_components(docs, width, similarity, block_shingles=400).collect()
    assert collections.Counter(tuple(r) for r in got) == components(documents(), width, similarity)
    assert ngram_join.ngram_components(none, width, similarity).count() == 0


def test_links_are_counted_within_and_across_segments(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(60)] = f"x{r.randrange(9)}"
        rows.append((i if i % 13 else None, " ".join(words)))
    rows += [(200 + i, None) for i in range(5)] + [(300, ""), (300, " ".join(base)), (301, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(rows, 3, Fraction(4, 5))
    assert max(links for *_, links in want) > 40
    for most in (150, 1_500_000):
        got = ngram_join.ngram_components(df, 3, Fraction(4, 5), block_shingles=most).collect()
        assert collections.Counter(tuple(x) for x in got) == want


def test_divide_skip_counts_like_a_counter():
    r = random.Random(3)
    for _ in range(100):
        lists = [np.array(sorted(r.sample(range(60), r.randint(1, 50)))) for _ in range(r.randint(1, 30))]
        least = r.randint(1, len(lists))
        want = {k: v for k, v in collections.Counter(np.concatenate(lists).tolist()).items() if v >= least}
        assert dict(zip(*(x.tolist() for x in ngram_join.divide_skip(lists, least, 0.3)))) == want


@pytest.mark.parametrize("similarity", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_linked_sets_share_a_signature(similarity):
    r = np.random.default_rng(4)
    for _ in range(300):
        both = r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64)
        room = int(len(both) * (1 - similarity) / similarity)
        extra = r.integers(0, 2**63, room).astype(np.uint64)
        at = r.integers(0, room + 1)
        a, b = np.unique(np.r_[both, extra[:at]]), np.unique(np.r_[both, extra[at:]])
        assert len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b))
        assert set(ngram_join.signatures(a, similarity)) & set(ngram_join.signatures(b, similarity))


# ---- 5


def test_shards_are_near_equal_and_slots_gapless(docs, none, spark):
    out = histogram_shards(docs, shards=6).collect()
    assert len(out) == len(documents())
    total = sum(r["bytes"] for r in out)
    largest = max(r["bytes"] for r in out)
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for r in out:
        assert r["bytes"] == len((r["text"] or "").encode()) + 8
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["bytes"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(load[s] - total / 6) <= largest + total * 0.01 for s in range(6))
    assert histogram_shards(none).count() == 0
    even = spark.range(5000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("text"))
    loads = [r[0] for r in histogram_shards(even, 24).groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(loads) == 24 and max(loads) - min(loads) <= 3 * 40
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    assert [r["count"] for r in histogram_shards(copies, 4).groupBy("shard").count().collect()] == pytest.approx([750] * 4, abs=3)


# ---- 6


def test_preferences_share_their_longest_prefix(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 1, "assistant", "no"), (1, 0, "user", "hi"),
        (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, None), (7, 5, "assistant", "alone"), (None, 0, "user", "x"),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, side int")
    out = {r["pair_id"]: r for r in preference_pairs(pair_by_number(turns)).collect()}
    assert set(out) == {0, 1, 2, 3}
    assert out[0]["prompt"] == "<|user|>\nhi<|end|>\n" and out[0]["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [out[0]["chosen"][m["start"] : m["start"] + m["length"]] for m in out[0]["chosen_mask"]] == ["yes<|end|>\n"]
    assert (out[1]["prompt_turns"], out[1]["chosen"], out[1]["rejected"]) == (1, "", "")
    assert out[2]["chosen"] == "<|unknown|>\n<|end|>\n" and out[2]["rejected"] == "" and out[2]["chosen_mask"] == []
    assert out[3]["prompt"] == "" and out[3]["rejected_turns"] == 1
    assert preference_pairs(pair_by_number(turns.limit(0))).count() == 0


def test_replies_are_paired_with_the_turns_before_them(spark):
    r = random.Random(4)
    rows = [
        (c, t, r.choice(["user", "assistant", "system"]), r.choice(["hi", "no", "yes", "", None]))
        for c in range(40) for t in range(r.randint(1, 6))
    ]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "x" * 90000), (50, 2, "user", "bye"), (None, 0, "assistant", "a"), (60, 0, None, None)]
    turns = spark.createDataFrame([(*x, 1) for x in rows + [(50, 1, "assistant", "x" * 90000)]], "conv_id long, turn long, role string, text string, pair_id int")
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t, role, text))
    reply = {c: [x for x in sorted(v, key=lambda x: x[0]) if x[1] == "assistant"][-1:] for c, v in by.items()}
    show = lambda v: "".join(f"<|{role or 'unknown'}|>\n{text or ''}<|end|>\n" for _, role, text in v)
    out = {x["pair_id"]: x for x in preference_pairs(pair_by_reply(turns)).collect()}
    assert set(out) == {c for c, v in reply.items() if v}
    for c, x in out.items():
        whole = sorted(by[c], key=lambda y: y[0])
        if c == 50:  # its reply stands twice
            whole = [whole[0], whole[1], whole[1], whole[2]]
        cut = whole.index(reply[c][0])
        other = [(0, "assistant", t[2]) for t in reply.get(c ^ 1, [])]
        a, b = [y[1:] for y in whole], [y[1:] for y in [*whole[:cut], *other]]
        same = next((i for i, (p, q) in enumerate(zip(a, b)) if (p[0], p[1] or "") != (q[0], q[1] or "")), min(len(a), len(b)))
        assert (x["prompt_turns"], x["prompt"]) == (same, show(whole[:same]))
        assert x["prompt"] + x["chosen"] == show(whole) and x["prompt"] + x["rejected"] == show([*whole[:cut], *other])
        trained = [x["chosen"][m["start"] : m["start"] + m["length"]] for m in x["chosen_mask"]]
        assert trained == [f"{t or ''}<|end|>\n" for _, role, t in whole[same:] if role == "assistant"]
    assert sum(x["prompt_turns"] > 0 for x in out.values()) > 10
    assert preference_pairs(pair_by_reply(turns.limit(0))).count() == 0


# ---- 7


def test_top_inner_products_are_exact(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.standard_normal(12) * (1 + i % 7)).round(2).tolist(), 0) for i in range(400)]
    rows += [(400, None, 0), (401, [None] * 12, 0), (402, [float("nan")] * 12, 0), (403, rows[7][1], 0), (404, [], 0), (405, [float("inf")], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for block in (64, 8192):
        got = collections.defaultdict(list)
        for x in top_inner_products(df, block=block, head=4).orderBy("query_id", "rank").collect():
            got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
        assert set(got) == {i for i in whole if i % 20 == 0}
        for q, found in got.items():
            score = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
            assert found == [(n + 1, i, -s) for n, (s, i) in enumerate(score)]
    assert top_inner_products(df.limit(0)).count() == 0


# ---- 8


def test_toxicity_learns_words_and_stems(spark, docs, none):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(10, 80))]
        if bad := i % 4 == 0:
            words[r.randrange(len(words))] = "zoxqu" + r.choice(["", "ab", "cd", "ef"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame([*rows, (900, None), (None, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1000, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    out = tox.toxicity(d, marks).collect()
    assert len(out) == 602 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out)
    held = [x for x in out if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in [*range(600), 900] if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [x["predicted"] == (x["doc_id"] % 4 == 0) for x in held if x["doc_id"] < 600]
    assert sum(right) >= 0.95 * len(right)
    unlabelled = tox.toxicity(docs, marks.limit(0))
    assert unlabelled.where("score <> 0").count() == 0 and unlabelled.count() == len(documents())
    assert tox.toxicity(none, marks).count() == 0


def test_two_labelled_documents_of_a_class_suffice(spark):
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    side = lambda i: hashlib.md5(str(i).encode()).hexdigest()[-1] > "9"
    for toxic in ([i for i in learned if not side(i)][:2], [i for i in learned if side(i)][:2]):
        rows = [(i, "zoxqu " * 9 + prose(30, i) if i in toxic else prose(40, i)) for i in range(200)]
        marks = [(i, 1, int(i in toxic)) for i in range(200) if i in toxic or i in learned]
        marks += [(900, 1, 1), (901, 1, 1)]
        d = spark.createDataFrame([*rows, (900, None), (901, " ")], "doc_id long, text string")
        out = tox.toxicity(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 202 and {r["doc_id"] for r in out if r["predicted"]} == set(toxic)


# ---- 9


def test_token_counts_are_the_librarys(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    r = random.Random(9)
    for _ in range(400):
        parts = ["a", "bc", " ", "  ", "\n", "é", "1", "<|endoftext|>", "'s", "漢字", ".", ", ", "\t", "word ", "The", "　"]
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        want = len(own.encode(text, add_special_tokens=False))
        assert PieceCounts(own).totals([text]) == [want]
        for chunk, overlap in ((8, 2), (40, 16)):
            assert resynchronised_count(own, text, chunk, overlap) == want
    for chunk in (100, 32768):
        out = token_counts(docs, path, chunk=chunk, overlap=10).collect()
        want = collections.Counter(
            (i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False))) for i, t, *_ in documents()
        )
        assert collections.Counter((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in out) == want
        assert all(x["over_limit"] == (x["n_tokens"] > 1024) for x in out)
    assert token_counts(none, path).count() == 0


# ---- 10


def backoff_by_hand(rows, order):
    """Scores of texts of tokens by the recursion, with counts in dictionaries; checks that the
    probabilities after every context sum to 1."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for _, x, learn in rows:
        if learn:
            whole = [b" ", *x]
            for n in range(1, order + 1):
                counts[n].update(tuple(whole[i : i + n]) for i in range(len(whole) - n + 1))
    words = {w: k for w, k in counts[1].items() if w != (b" ",)}
    n, v = sum(words.values()), len(words)
    strengths = {}
    for k in range(2, order + 1):
        contexts = [c for g, c in counts[k - 1].items() if g[-1] != b""]
        by = collections.defaultdict(list)
        for c in contexts:
            by[c.bit_length()].append(c)
        once = sum(c == 1 for c in counts[k].values())
        low, high = 1e-3, 1e6
        for _ in range(60):
            s = math.sqrt(low * high)
            fails = sum(sum(g) * s / (sum(g) / len(g) + s) for g in by.values())
            low, high = (s, high) if fails < once else (low, s)
        strengths[k] = math.sqrt(low * high)

    def p(context, w):
        k = len(context) + 1
        if k == 1:
            return (words.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))
        shorter, seen = p(context[1:], w), counts[k - 1][context]
        return (counts[k][(*context, w)] + strengths[k] * shorter) / (seen + strengths[k]) if seen else shorter

    for context in list(counts[order - 1])[:5] if order > 1 else []:
        if context[-1] != b"":
            assert sum(p(context, w[0]) for w in words) + 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1, abs=0.02)
    out = []
    for i, x, learn in rows:
        whole = [b" ", *x]
        logs = [math.log10(p(tuple(whole[max(0, j - order + 1) : j]), whole[j])) for j in range(1, len(whole))]
        base = sum(math.log10(p((), w)) for w in x)
        out.append((-1 if i is None else i, not learn, len(x), sum((w,) in words for w in x), n, base, sum(logs)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_scores(docs, none, order, monkeypatch):
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    rows = [(i, [*(t or "").encode().lower().split(), b""], learned(i)) for i, t, *_ in documents()]
    want = backoff_by_hand(rows, order)
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, lm_scores(docs, order).collect())]
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    if order == 3:
        assert lm_scores(none).count() == 0
        unlearned = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
        assert {(r["base_score"], r["score"], r["train_tokens"]) for r in lm_scores(unlearned).collect()} == {(0.0, 0.0, 0)}
