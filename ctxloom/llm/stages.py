"""The operators as stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

All but the last return the columns of documents, and rows as they came. Repeated rows are each kept or
dropped for itself but by jaccard_dedup; an empty table stays empty; very long texts are read whole,
with 50 to 100 bytes of memory for each of their bytes; doc_ids are whole numbers or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, jaccard_join, langid, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep; null and empty texts go."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is determined; learned from the documents that came here. Null and empty texts go."""
    return langid.keep(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id, null last; null and empty texts are a class each."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark table; null and empty texts hold none, null and empty items are held by none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; null and empty texts have the token that ends a document alone."""
    return packing.pack(docs)
