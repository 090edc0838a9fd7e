"""A corpus from raw documents to packed windows: five stages, each written and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import exactdedup, jaccard, langid, packing, toxicity
from quillmesh.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly. Null texts and texts without a letter go; repeated rows stay. An empty table gives no rows."""
    return langid.keep_known_languages(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts and repeated rows stay. An empty table gives no rows."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the largest doc_id, once. An empty table gives no rows."""
    return exactdedup.keep_one_of_each(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id. Texts without words and rows without doc_id stay. An empty table gives no rows."""
    return jaccard.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows; a null text has its end id only, each repeated row its own pieces. An empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("toxicity", not_toxic), ("exact_dedup", without_copies), ("ngram_jaccard", without_near_copies), ("packing", packed)]

#: No SQL for the first two stages' models and the last one's packing; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
