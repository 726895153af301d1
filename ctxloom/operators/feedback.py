"""Time-decayed feedback and the importance that it lends to memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import decay

HALF_LIFE_MINUTES, BY_ID, BY_TYPE = 60.0, 0.7, 0.3


def decayed_average(feedback: DataFrame, key: str, as_of: Column, half_life: float = HALF_LIFE_MINUTES) -> DataFrame:
    """key, average, entries. One partial aggregation; a total weight of 0 gives 0."""
    w = decay(F.col("ts"), as_of, half_life)
    total = F.sum(w)
    return feedback.groupBy(key).agg(F.when(total > 0, F.sum(F.col("score") * w) / total).otherwise(0.0).alias("average"), F.count("*").alias("entries"))


def summary(feedback: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Averages by id and by type, the first seen first, at most `limit` of each (a report)."""
    out = None
    for level, key in (("component", "component_id"), ("type", "component_type")):
        w = decay(F.col("ts"), as_of)
        one = feedback.groupBy(key).agg(F.min("event_id").alias("first"), F.when(F.sum(w) > 0, F.sum(F.col("score") * w) / F.sum(w)).otherwise(0.0).alias("average"), F.count("*").alias("entries"))
        one = one.orderBy("first").limit(limit).select(F.lit(level).alias("level"), F.col(key).alias("key"), "average", "entries")
        out = one if out is None else out.unionByName(one)
    return out


def importance(memory: DataFrame, feedback: DataFrame, as_of: Column) -> DataFrame:
    """memory with `importance`: its score, 0.7 of its own and 0.3 of its type's average."""
    own = decayed_average(feedback, "component_id", as_of).select(F.col("component_id").alias("id"), F.col("average").alias("_own"))
    kind = decayed_average(feedback, "component_type", as_of).select(F.col("component_type").alias("type"), F.col("average").alias("_kind"))
    total = F.col("score") + BY_ID * F.coalesce("_own", F.lit(0.0)) + BY_TYPE * F.coalesce("_kind", F.lit(0.0))
    return memory.join(own, "id", "left").join(kind, "type", "left").withColumn("importance", total).drop("_own", "_kind")
