"""Exact deduplication by sorting contents.

Texts are normalised and dealt by ranges of their bytes, whose splitters Spark samples; each range is
sorted externally, so equal texts are neighbours, and neighbours are compared in full. A splitter is
the first bytes of a text, its SHA-256 and the row's id, so that a sample of long texts is small and
a group of equal texts of any size is cut into ranges of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import KEY, runs

#: A splitter's bytes of a text; the rest of the order is by SHA-256, and neighbours are compared whole.
SPLITTER_BYTES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _numbered(docs: DataFrame, id: str, text: Column, keep: str, rows: bool) -> DataFrame:
    """id, text_sha256, keep_id, group_size, kept, and the whole row where it is asked for."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if rows else []
    table = docs.select(docs[id].alias("id"), text.alias(KEY), F.spark_partition_id().alias("split"), *whole)
    table = table.withColumn("sha", F.unhex(F.sha2(F.col(KEY).cast("binary"), 256))).withColumn("start", F.substring(F.col(KEY).cast("binary"), 1, SPLITTER_BYTES))
    # the row that stays is the group's first or last; a null id stays only where there is no other
    place = F.asc_nulls_last("id") if keep == "smallest" else F.asc_nulls_first("id")
    numbered, groups = runs(table, ["start", "sha", place, "split"], ["start", "sha", KEY, place, "split"], "content-sort")
    ids = numbered.groupBy("part", "run").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    groups = groups.join(ids, ["part", "run"])
    which, best = (F.min, F.min("least")) if keep == "smallest" else (F.max, F.max("most"))
    stays = groups.groupBy("head_part", "head_run").agg(best.alias("keep_id"), F.sum("n").alias("group_size"), which(F.struct("part", "run", "n")).alias("stays"))
    groups = groups.join(stays, ["head_part", "head_run"]).withColumn("here", (F.col("stays.part") == F.col("part")) & (F.col("stays.run") == F.col("run")))
    pos = F.lit(0) if keep == "smallest" else F.col("n") - 1
    out = numbered.join(groups.select("part", "run", "keep_id", "group_size", F.when(F.col("here"), pos).alias("kept_pos")), ["part", "run"])
    kept = F.coalesce(F.col("pos") == F.col("kept_pos"), F.lit(False))
    return out.select("id", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", kept.alias("kept"), *["row"] * rows)


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", normalise=normalised) -> DataFrame:
    """One row of (id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Rows whose normalised texts are equal in full are a group, of which the smallest (or largest) id
    stays; a null id stays only where the group has no other, and its keep_id is null then. Of rows
    that repeat an id with an equal text exactly one has `kept`, any of them. Null texts are empty
    ones, and empty texts are a group. Texts are compared whole, however long; a task holds batches
    of them. Other columns, whatever their names, aren't read. An empty table gives no rows.
    """
    out = _numbered(docs, id, normalise(docs[text]), keep, False)
    return out.select(F.col("id").alias(id), "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", normalise=normalised) -> DataFrame:
    """The rows that stay, with all their columns; cases as in groups()."""
    return _numbered(docs, id, normalise(docs[text]), keep, True).where("kept").select("row.*")
