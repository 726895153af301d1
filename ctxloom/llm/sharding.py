"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard is a function of its key and the number of shards alone. With one shard more, a
row either keeps its shard or moves to the new one, and about 1 in n + 1 rows moves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of unsigned 64-bit keys."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keys = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    step = np.zeros(len(keys), np.int64)
    while len(going):
        at[going] = step[going]
        keys[going] = keys[going] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (keys[going] >> np.uint64(33)).astype(np.float64) + 1
        step[going] = ((at[going] + 1) * (2.0**31 / draw)).astype(np.int64)
        going = going[step[going] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key."""

    @F.pandas_udf("int")
    def place(keys):
        return keys.__class__(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def shard(df: DataFrame, key: str, shards: int, order: list[str] = (), parts: int | None = None) -> DataFrame:
    """All columns, then `shard`, `grown_shard` (with one shard more) and `slot`, gapless from 0 in each shard.

    The key is hashed by xxhash64 of its text, so equal keys share a shard; null keys share one
    too. Slots are dealt in two steps, so that no shard meets in one task: rows get a number
    inside a fine part of their shard (by another hash of `key` and `order`), and the parts' sizes
    are summed ahead of them. Rows that are equal in key and `order` may swap their slots.
    An empty table gives an empty result. A table that has one of the three columns is an error.
    """
    if clash := {"shard", "grown_shard", "slot"} & set(df.columns):
        raise ValueError(f"the table has columns of these names: {sorted(clash)}")
    spark = df.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    hashed, part = F.xxhash64(text), F.pmod(F.xxhash64(F.lit(1), text, *[F.col(c) for c in order]), F.lit(parts)).cast("int")
    placed = df.select(F.struct("*").alias("row"), hashed.alias("key"), F.struct(key, *order).alias("order"), part.alias("part"))
    placed = placed.select("*", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"))
    sizes = placed.groupBy("shard", "part").count()
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("key", "order")
    numbered = placed.withColumn("n", F.row_number().over(inside) - 1).join(starts, ["shard", "part"])
    return numbered.select("row.*", "shard", "grown_shard", (F.col("start") + F.col("n")).alias("slot"))


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write a sharded table as one folder a shard, each of several files."""
    df.repartition("shard", (F.col("slot") % files_per_shard)).write.partitionBy("shard").parquet(path)

