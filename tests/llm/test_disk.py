"""What the n-gram join leaves on disk while it runs: one step's shuffles, a bounded number of copies."""

from __future__ import annotations

import os
import random
from fractions import Fraction

import corpus_pipeline
from courselake.llm import common, ngram_join


def _docs(spark, n):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[draw.choice(words) for _ in range(150)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = list(base[i % 4])
        text[draw.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_copies_for_segments_are_dealt_into_rounds(spark, monkeypatch):
    docs = _docs(spark, 60)
    links = []
    real = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: links.append(df.columns) or real(df))

    def found(**settings):
        links.clear()
        rows = ngram_join.ngram_components(docs, 3, Fraction(4, 5), **settings).collect()
        return sorted(map(tuple, rows)), links.count(["a", "b", "partners"])

    whole, once = found()
    assert once == 1 and len({r[2] for r in whole}) == 4 and min(r[3] for r in whole) > 0
    cut, rounds = found(block_shingles=400)  # about six segments a block
    assert cut == whole and rounds > 2


def test_a_stage_leaves_no_shuffle_files(spark, tmp_path):
    docs = _docs(spark, 40)
    before = spark.conf.get(common.CLEANUP_SETTING, None)

    def left() -> int:
        home = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(
            name.startswith("shuffle_") for d in home.localDirs() for _, _, names in os.walk(d.getPath()) for name in names
        )

    spark.conf.unset(common.CLEANUP_SETTING)
    files = left()
    try:
        corpus_pipeline.keep_one_of_a_group(spark, docs, "").write.parquet(str(tmp_path / "kept"))
        assert left() <= files
    finally:
        if before is not None:
            spark.conf.set(common.CLEANUP_SETTING, before)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 4
