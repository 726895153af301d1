"""The corpus pipeline: stages over the documents table, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import stages
from ctxloom.scratch import materialise

STAGES = [
    ("quality rules", stages.quality_rules),
    ("language ID", stages.language_id),
    ("n-gram Jaccard join", stages.jaccard_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("packing", stages.packed),
]

#: Suffix arrays and the stages after them can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: pieces of the documents that are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
