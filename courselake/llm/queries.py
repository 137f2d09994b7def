"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courselake.llm.common import table
from courselake.llm.conversation_trie import spliced_trie
from courselake.llm.curriculum import curriculum, in_training_order
from courselake.llm.decontamination import with_leaks
from courselake.llm.hard_negatives import hard_negatives
from courselake.llm.language_model import lm_scores
from courselake.llm.ngram_join import ngram_components
from courselake.llm.preferences import pair_by_reply, preference_pairs
from courselake.llm.pseudonyms import pseudonymised
from courselake.llm.repeats import repeated_spans
from courselake.llm.sharding import histogram_shards
from courselake.llm.token_counts import token_counts
from courselake.llm.topk import top_inner_products
from courselake.llm.toxicity import toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum(table(spark, sf_dir, "documents"))
    return in_training_order(plan).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 6).alias("position")
    )


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs).select("doc_id", "n_replaced", "text")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return histogram_shards(docs).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(pair_by_reply(table(spark, sf_dir, "conversations")))


def op7_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spliced_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_curriculum": op2_curriculum,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_ngram_join": op4_ngram_join,
    "op5_histogram_sort": op5_histogram_sort,
    "op6_preferences": op6_preferences,
    "op7_top_inner_products": op7_top_inner_products,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_backoff_automaton": op10_backoff_automaton,
    "op11_repeated_spans": op11_repeated_spans,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_trie": op13_conversation_trie,
}
