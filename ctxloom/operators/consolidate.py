"""Table updates that derive, merge, contradict, resolve and expire memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import active, expired
from .rank import numbered


def derive(memory: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, violations) of commands (new_id, content, source_ids, supersede).

    No source, an unknown source, blank content or an id that exists is a violation. Without content
    the sources' contents are joined by blank lines in the order given (a merge).
    """
    sources = commands.select("new_id", F.posexplode_outer("source_ids").alias("pos", "id"))
    found = sources.join(memory.select("id", F.col("content").alias("_content"), F.lit(1).alias("_known")), "id", "left")
    per = found.groupBy("new_id").agg(
        F.count("id").alias("n"),
        F.sum(F.when(F.col("id").isNotNull() & F.col("_known").isNull(), 1).otherwise(0)).alias("unknown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_content"))), lambda x: x._content), "\n\n").alias("joined"),
    )
    taken = memory.select(F.col("id").alias("new_id"), F.lit(1).alias("_taken"))
    checked = commands.join(per, "new_id", "left").join(taken, "new_id", "left").withColumn("content", F.coalesce("content", "joined"))
    why = F.when(F.coalesce("n", F.lit(0)) == 0, "no_sources").when(F.col("unknown") > 0, "unknown_source").when(F.trim(F.coalesce("content", F.lit(""))) == "", "blank_content").when(F.col("_taken") == 1, "id_exists")
    checked = checked.withColumn("violation", why)
    return checked.where("violation is null").select("new_id", "content", "source_ids", "supersede"), checked.where("violation is not null").select("new_id", "violation")


def superseded(memory: DataFrame, made: DataFrame) -> DataFrame:
    """memory with the sources of superseding commands marked."""
    old = made.where("supersede").select(F.explode("source_ids").alias("id")).distinct().withColumn("_old", F.lit(True))
    return memory.join(old, "id", "left").withColumn("status", F.when(F.col("_old"), "superseded").otherwise(F.col("status"))).drop("_old")


def contradicted(pairs: DataFrame) -> DataFrame:
    """id, contradiction_ids: symmetric and without repeats; a pair with itself is left out."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a")).where("id <> other")
    return both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("contradiction_ids"))


def resolve(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (winner, loser): losers are superseded, winners list them, and both drop each other."""
    lost = decisions.groupBy(F.col("loser").alias("id")).agg(F.collect_set("winner").alias("_by"))
    won = decisions.groupBy(F.col("winner").alias("id")).agg(F.array_sort(F.collect_set("loser")).alias("_over"))
    none = F.array().cast("array<string>")
    out = memory.join(lost, "id", "left").join(won, "id", "left")
    out = out.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status")))
    out = out.withColumn("supersedes_ids", F.array_union("supersedes_ids", F.coalesce("_over", none)))
    gone = F.array_union(F.coalesce("_by", none), F.coalesce("_over", none))
    return out.withColumn("contradiction_ids", F.array_except("contradiction_ids", gone)).drop("_by", "_over")


def expire_due(memory: DataFrame, as_of: Column) -> DataFrame:
    """memory with `newly_expired`, and the status of those set."""
    due = (F.col("status") == "active") & expired(F.col("expires"), as_of)
    return memory.withColumn("newly_expired", due).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def active_view(memory: DataFrame, as_of: Column) -> DataFrame:
    return memory.where(active(F.col("status"), F.col("expires"), as_of))


def synthesis(claims: DataFrame, by: str = "project") -> DataFrame:
    """The derived content of each project as one row for each of its claims: by, pos from 0, content, confidence (the least of all), n_claims.

    A project's claims are as many as there are, so they are numbered by `seq` and stay rows.
    """
    totals = claims.groupBy(F.col(by).alias("_by")).agg(F.min("confidence").alias("confidence"), F.count("*").alias("n_claims"))
    placed = numbered(claims.select(by, "seq", F.col("text").alias("content")), by, "seq", "pos")
    return placed.join(totals, placed[by].eqNullSafe(totals["_by"])).select(by, "pos", "content", "confidence", "n_claims")


def lineage(derived: DataFrame, memory: DataFrame) -> DataFrame:
    """id, pos, source_id and the source's content, in order."""
    edges = derived.select("id", F.posexplode("provenance_ids").alias("pos", "source_id"))
    return edges.join(memory.select(F.col("id").alias("source_id"), "content"), "source_id")
