"""The corpus pipeline: quality filter, near-dedup, passage dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``documents``.

Defined cases are those of the operators: null, empty and blank texts have the score of
features that are all zero and go or stay by it, and pass the later filters, which look at
words; rows equal in id and text are one class; rows without an id are documents like
others; an empty table passes through; columns beside doc_id, text and n_chars are carried
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfold.llm import bpe, decontaminate, neardup, quality, suffix
from lagfold.llm.queries import table, word_bpe_spec
from lagfold.llm.spark import cut, fresh, sized


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of passages of 50 words or more; n_chars follows the text."""
    return suffix.without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; documents and items are told by the hashes of their texts, as ids may be null or repeated."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.xxhash64("text").alias("item_id"), "text")
    (hit,) = fresh(docs.columns, "_hit")
    found = cut(decontaminate.contained(keyed, items).select(F.col("doc_id").alias(hit)).distinct())
    return docs.join(sized(found), F.xxhash64(docs["text"]) == F.col(hit), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, by their digests."""
    return bpe.encode(docs, word_bpe_spec())


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can't express the classifier, the signatures' classes and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
