"""A corpus from documents to packed windows, stage by stage.

Each stage calls an operator of matrixloom.llm on all that the stage before kept; each result is
written to the shared folder and read back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matrixloom.llm import exact_dedup, language_id, near_dup, packing, quality
from matrixloom.llm.common import cut, small_batches, table

#: Least share of a text's letters that its language must have.
LEAST_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose Bradley-Terry score is at or over the cut."""
    small_batches(spark)
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, ranker)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language, one that has at least LEAST_SHARE of the letters."""
    small_batches(spark)
    return language_id.keep_known(docs, language_id.train(docs), LEAST_SHARE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, by SimHash with pivot distance tables."""
    small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 tokens: a row for each piece."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("packing", packing_stage),
]

#: A learned classifier, a Viterbi labelling and a packing are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
