"""Memory, feedback, request and evidence tables: reading, upserts, deletes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import numbered_in_spans, spans

LIFECYCLE = "kind string, status string, provenance_ids array<string>, supersedes_ids array<string>, contradiction_ids array<string>, expires_at timestamp, confidence double"
MEMORY = f"schema_version int, id string, type string, tags array<string>, content string, score double, component_data string, memory struct<{LIFECYCLE}>"
FEEDBACK = "component_id string, component_type string, score double, ts timestamp"


def read_memory(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Memory records from a JSON list, Parquet or a JDBC table, with a fixed schema."""
    if fmt == "json":
        return spark.read.schema(MEMORY).option("multiLine", True).json(path)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=path, **options).load()
    return spark.read.schema(MEMORY).format(fmt).load(path)


def parse_memory(records: DataFrame, value: str = "record") -> DataFrame:
    """Memory records from a table with one JSON text a row; a broken text gives a row of nulls with an `error`."""
    parsed = F.from_json(value, MEMORY)
    whole = F.from_json(value, "map<string, string>").isNotNull()
    return records.select(F.when(whole, parsed).alias("m"), F.when(~F.coalesce(whole, F.lit(False)), "broken record").alias("error")).select("m.*", "error")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A log as {component_id: [entries]}; an entry that is a bare number has no time and type Unknown."""
    return parse_feedback(spark.read.text(path, wholetext=True))


def parse_feedback(logs: DataFrame, value: str = "value") -> DataFrame:
    """The entries of logs as texts, by component and place."""
    raw = logs.select(F.from_json(value, "map<string, array<string>>").alias("log"))
    entries = raw.select(F.explode("log").alias("component_id", "entries")).select("component_id", F.posexplode("entries").alias("pos", "entry"))
    full = F.from_json("entry", "score double, component_type string, timestamp string")
    bare = F.expr("try_cast(entry as double)")
    return entries.select("component_id", "pos", F.coalesce(full.component_type, F.lit("Unknown")).alias("component_type"), F.coalesce(bare, full.score).alias("score"), F.try_to_timestamp(full.timestamp).alias("ts"))


def append_feedback(entries: DataFrame, path: str) -> None:
    """Add entries to the log kept as Parquet: an append that keeps what is there. A score beyond [-1, 1], or none, is an error."""
    if not entries.where(~F.coalesce(F.abs("score") <= 1, F.lit(False))).isEmpty():
        raise ValueError("a score must be from -1 to 1")
    entries.select("component_id", "component_type", "score", "ts").write.mode("append").parquet(path)


def upsert(table: DataFrame, updates: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Last write wins by `version`; `seq` stays that of the first insert."""
    both = table.unionByName(updates)
    of = Window.partitionBy(key)
    ranked = both.withColumn("_n", F.row_number().over(of.orderBy(F.desc(version), F.desc("seq")))).withColumn("seq", F.min("seq").over(of))
    return ranked.where("_n = 1").drop("_n")


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids, key, "left_semi")


def register(table: DataFrame, new: DataFrame, on_duplicate: str = "error", key: str = "id") -> DataFrame:
    """Add rows; duplicates of the table are skipped, replaced or an error. Empty ids are an error."""
    if not new.where((F.col(key) == "") | F.col(key).isNull()).isEmpty():
        raise ValueError("empty id")
    if on_duplicate == "skip":
        return table.unionByName(new.join(table, key, "left_anti"))
    if on_duplicate == "replace":
        return upsert(table, new, key)
    if on_duplicate != "error":
        raise ValueError("on_duplicate must be skip, replace or error")
    if not new.join(table, key, "left_semi").isEmpty():
        raise ValueError("duplicate id")
    return table.unionByName(new)


def store_stats(table: DataFrame, kind: str = "type") -> DataFrame:
    return table.groupBy(kind).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def record_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def evidence(log: DataFrame, record_type: str | None = None) -> DataFrame:
    """The log in order, of one type or all."""
    return (log.where(F.col("record_type") == record_type) if record_type else log).orderBy("sequence")


def append_evidence(log: DataFrame, records: DataFrame) -> DataFrame:
    """New rows of the log: hashed and numbered on. A (type, id) that is there already, or twice, is an error."""
    keys = ["record_type", "record_id"]
    if not records.join(log, keys, "left_semi").isEmpty() or not records.groupBy(keys).count().where("count > 1").isEmpty():
        raise ValueError("duplicate record")
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    rows = records.withColumn("payload_hash", record_hash(F.col("payload_json")))
    rows = numbered_in_spans(rows, [], keys, spans(records, keys), "_n")
    return rows.join(F.broadcast(last)).withColumn("sequence", F.col("last") + 1 + F.col("_n")).drop("_n", "last")


def decode(payload: Column, field: str, default: Column) -> Column:
    """A field of a JSON payload; a missing or broken payload, or a missing field, gives the default."""
    return F.coalesce(F.from_json(payload, "map<string, string>", {"mode": "PERMISSIVE"})[field], default)


def replace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that `new` has are replaced by its rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
