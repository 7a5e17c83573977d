"""One query opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, language_model, line_dedup, merkle, minhash, mixing, multiset_hash, nearest, packing, personal, quality, simhash, token_prefix
from tidemark.llm.frames import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    found = quality.scored(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"), F.expr("total * 8 div 10"), max_epochs=2, seed=17)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=4096, end_id=1)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.without_repeats(docs, errors=None)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("left_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), share=0.8, width=2)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_personal_data": op2_personal_data,
    "op3_multiset_fingerprints": op3_multiset_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_lm_scores": op8_lm_scores,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: The other methods can't be written in SQL that ends in time on whole tables; tests hold them against brute force.
ORACLES: dict[str, str] = {"op6_source_mixing": mixing.ORACLE}
