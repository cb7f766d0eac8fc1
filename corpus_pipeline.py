"""Corpus pipeline: classify, de-duplicate three ways, pack.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written
as Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from matchlake.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id."""
    return near_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; documents left without words go."""
    # each row brings its other columns along: ids may be null or repeated
    rows = docs.select("doc_id", "text", F.struct(
        F.struct(*[c for c in docs.columns if c != "text"]).alias("columns"),
        F.col("text").isNull().alias("no_text")).alias("row"))
    found = substring_dedup.remove_repeats(rows, carried="row") \
        .where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    values = {c: F.col("row.columns")[c] for c in docs.columns if c != "text"}
    values["text"] = F.when(~F.col("row.no_text"), F.col("kept_text"))
    values["n_chars"] = F.when(changed, F.length("kept_text").cast("long")) \
        .otherwise(values["n_chars"])
    return found.select(*[values[c].alias(c) for c in docs.columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: Training and tokenising cannot be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
