"""Evaluation sets and experiment bundles from JSON, and memory records to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION = "name string, cases array<struct<id: string, query: string, relevant_ids: array<string>, excluded_ids: array<string>, relevance: map<string, double>>>"
ITEM = "context_item_id: string, content: string, token_count: int, source: string, confidence: double, created_timestamp: string, metadata: map<string, array<string>>"
LABELS = "required: array<string>, useful: array<string>, misleading: array<string>, irrelevant: array<string>"
CASE = f"case_id: string, family_id: string, split: string, ordinal: int, prompt: string, token_budget: int, candidates: array<struct<{ITEM}>>, labels: struct<{LABELS}>"
BUNDLE = f"schema_version string, cases array<struct<{CASE}>>"


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, labels, excluded): a relevant id without a grade has gain 1; a graded id counts even if it isn't listed as relevant."""
    return evaluation_tables(spark.read.schema(EVALUATION).option("multiLine", True).json(path))


def evaluation_tables(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of evaluation sets in the schema EVALUATION."""
    cases = sets.select(F.explode("cases").alias("c")).select("c.*").withColumnRenamed("id", "query_id")
    listed = cases.select("query_id", F.explode("relevant_ids").alias("id")).withColumn("listed", F.lit(True))
    graded = cases.select("query_id", F.explode("relevance").alias("id", "grade"))
    labels = listed.join(graded, ["query_id", "id"], "full_outer").select("query_id", "id", F.coalesce("grade", F.lit(1.0)).alias("gain"), F.coalesce("listed", F.lit(False)).alias("relevant"))
    return cases.select("query_id", "query"), labels, cases.select("query_id", F.explode("excluded_ids").alias("id"))


def read_bundle(spark: SparkSession, path: str, version: str = "3") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, candidates, labels) of an experiment; a candidate's place is kept, and another version is an error."""
    return bundle_tables(spark.read.schema(BUNDLE).option("multiLine", True).json(path), version)


def bundle_tables(raw: DataFrame, version: str = "3") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of bundles in the schema BUNDLE."""
    if not raw.where(~F.col("schema_version").eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError("unsupported schema version")
    cases = raw.select(F.explode("cases").alias("c")).select("c.*")
    candidates = cases.select("case_id", F.posexplode("candidates").alias("pos", "item")).select("case_id", "pos", "item.*").withColumnRenamed("context_item_id", "item_id")
    names = ("required", "useful", "misleading", "irrelevant")
    marks = F.array(*[F.struct(F.lit(n).alias("label"), F.col("labels")[n].alias("ids")) for n in names])
    labels = cases.select("case_id", F.explode(marks).alias("m")).select("case_id", "m.label", F.explode("m.ids").alias("item_id"))
    return cases.drop("candidates", "labels"), candidates, labels


def encode(memory: DataFrame, payload: list[str]) -> DataFrame:
    """Memory records as JSON lines: fixed fields and the type's own as a payload."""
    fields = [F.lit(1).alias("schema_version"), "id", "type", "tags", "content", "score", F.to_json(F.struct(*payload)).alias("component_data")]
    return memory.select("id", F.to_json(F.struct(*fields)).alias("record"))


@dataclass(frozen=True)
class Codec:
    """How records of one type are read from their payload: its schema, and columns made of it."""

    schema: str
    content: Callable[[Column], Column]
    score: Callable[[Column], Column]


def typed(records: DataFrame, codecs: dict[str, Codec]) -> DataFrame:
    """Records (type, content, score, component_data) with content and score by the codec of their type.

    Types without a codec keep theirs, as do records whose payload is missing or broken.
    """
    if not all(codecs):
        raise ValueError("a codec needs the name of a type")
    content, score = F.col("content"), F.col("score")
    for name, codec in codecs.items():
        payload = F.when(F.col("type") == name, F.from_json("component_data", codec.schema))
        content, score = F.coalesce(codec.content(payload), content), F.coalesce(codec.score(payload), score)
    return records.withColumns({"content": content, "score": score})
