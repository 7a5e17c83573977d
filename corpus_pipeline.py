"""From raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all that the one before
it kept; results go through Parquet in between.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, quality, simhash
from tidemark.llm.frames import cut, held_out, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from part of the labels, doesn't reject."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return quality.keep_good(docs, model)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another document, or they themselves, had before; those that lost lines and have only white space left go.

    All columns keep their names and values but ``text`` and, where lines went,
    ``n_chars``.  Null and empty texts, and those of white space alone, lose no
    line and stay; of rows with the same id or none each is a document of its own.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    aside = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("_row"))
    left = line_dedup.without_repeats(aside, errors=None).where(F.col("n_dropped").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    now = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        was = F.col(f"_row.{names[docs.columns.index('n_chars')]}")
        now["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(was)
    return left.select(*(now.get(c, F.col(f"_row.{n}")).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts that share 0.8 of their five-word shingles, and what such links connect."""
    return simhash.keep_one(docs, share=0.8, width=5)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, as many tokens in all as there are."""
    return mixing.mixed(docs, F.col("total"), max_epochs=2, seed=17)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limit=4096, end_id=1)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", first_lines),
    ("simhash_near_dedup", one_of_each),
    ("source_mixing", in_proportion),
    ("best_fit_packing", packed),
]
#: The classifier and the edit join have no SQL form; the tests hold the stages against plain versions and labels, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
