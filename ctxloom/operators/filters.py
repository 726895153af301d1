"""Predicates on memories, and the reason for which a candidate is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import substring


def tag_match(tags: Column, include: Column, mode: Column) -> Column:
    """Any or all of the wanted tags; no wanted tags match all. A mode other than `any` and `all` is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown tag mode: "), F.coalesce(mode, F.lit("null")))).cast("boolean")
    found = F.when(mode == "all", F.size(F.array_except(include, tags)) == 0).when(mode == "any", F.arrays_overlap(tags, include)).otherwise(wrong)
    return F.coalesce(F.size(include), F.lit(0)).__le__(0) | found


def type_match(kind: Column, types: Column) -> Column:
    return (F.coalesce(F.size(types), F.lit(0)) <= 0) | F.array_contains(types, kind)


def task_match(kind: Column, id_: Column, task: Column) -> Column:
    """Only summaries of another task are left out."""
    return task.isNull() | (kind != "TaskSummaryComponent") | (id_ == task)


def required_miss(terms: Column, required: Column) -> Column:
    """Whether none of the required texts' terms is among `terms`; no required text misses nothing, texts without a term are always missed."""
    wanted = F.flatten(F.transform(required, text.terms))
    return (F.coalesce(F.size(required), F.lit(0)) > 0) & ~F.arrays_overlap(terms, wanted)


def expired(expires: Column, as_of: Column) -> Column:
    return F.coalesce(expires <= as_of, F.lit(False))


def active(status: Column, expires: Column, as_of: Column) -> Column:
    return (F.coalesce(status, F.lit("active")) == "active") & ~expired(expires, as_of)


def reason(row: dict[str, Column], as_of: Column) -> Column:
    """First reason against a candidate, or `eligible`; expiry outranks the status label."""
    status = F.coalesce(row["status"], F.lit("active"))
    inactive = ~F.coalesce(row["include_inactive"], F.lit(False))
    return (
        F.when(inactive & expired(row["expires"], as_of), "lifecycle_expired")
        .when(inactive & (status != "active"), F.concat(F.lit("lifecycle_"), status))
        .when(~tag_match(row["tags"], row["include_tags"], row["tag_mode"]), "tag_filter")
        .when(~type_match(row["type"], row["types"]), "type_filter")
        .when(~task_match(row["type"], row["id"], row["task_id"]), "task_filter")
        .otherwise("eligible")
    )


def score_bin(score: Column) -> Column:
    return F.when(score < 0.5, "0.0-0.5").when(score < 1, "0.5-1.0").when(score < 2, "1.0-2.0").otherwise("2.0+")


def index_lookup(memory: DataFrame, kind: str | None = None, tags: list[str] = (), least: float | None = None) -> DataFrame:
    """Memories of a type with all tags in a score's bin; predicates reach the scan."""
    out = memory.where(F.col("type") == kind) if kind else memory
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    return out.where(score_bin(F.col("score")) == score_bin(F.lit(least))) if least is not None else out


def first_n(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def keyword_search(queries: DataFrame, memory: DataFrame, limit: int) -> DataFrame:
    """query_id, id, seq, rank, score: memories that hold a word of the query anywhere, in insertion order; the score is 0.5.

    Words of queries are found in the vocabulary of the memories, and no word carries more than its
    first `limit` memories, as no others can be among a query's first.
    """
    held = memory.select("id", "seq", F.explode(substring.words(F.lower("content"))).alias("word"))
    first = first_n(held, limit, ["word"], ["seq", "id"]).drop("rank")
    asked = queries.select("query_id", F.explode(substring.words(F.lower("query"))).alias("needle"))
    found = substring.contained(asked.select("needle"), first.select("word")).join(first, "word").select("needle", "id", "seq").distinct()
    found = first_n(found, limit, ["needle"], ["seq", "id"]).drop("rank")
    hits = asked.join(found, "needle").select("query_id", "id", "seq").distinct()
    return first_n(hits, limit, ["query_id"], ["seq", "id"]).withColumn("score", F.lit(0.5))


def source_policy(policy: str, source_class: Column) -> Column:
    """Null if a source may be used, else why not."""
    if policy == "authoritative":
        return F.when(~source_class.isin("primary_authority", "strong_secondary"), F.concat(F.lit("Source class "), source_class, F.lit(" rejected by authoritative policy")))
    if policy == "exclude-community":
        return F.when(source_class.isin("community_or_folklore", "retail"), F.concat(F.lit("Source class "), source_class, F.lit(" rejected by policy")))
    return F.lit(None).cast("string")


def overdue(deadline: Column, as_of: Column) -> Column:
    """Past its deadline, whatever the status; a deadline that can't be read never is."""
    return F.coalesce(F.try_to_timestamp(deadline) < as_of, F.lit(False))


def retained(ts: Column, as_of: Column, days: int) -> Column:
    """Not older than so many days; a time that can't be read is not retained."""
    return F.coalesce(F.try_to_timestamp(ts) >= as_of - F.expr(f"interval {int(days)} days"), F.lit(False))
