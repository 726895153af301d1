"""Streams give what their batch forms give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ctxloom.operators.feedback import decayed_average
from ctxloom.streaming import live

SCHEMA = "event_id long, component_id string, score double, ts timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, f"c{i % 3}", i % 5 / 5, start + timedelta(minutes=7 * i)) for i in range(30)]
    for part in (rows[:20:2], rows[1:20:2], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_upserts_are_idempotent(spark, folder):
    sink = live.upsert_sink(str(folder / "table"))
    one = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, seq long, version long")
    two = spark.createDataFrame([("a", 5, 2)], one.schema)
    for batch, id_ in ((one, 0), (two, 1), (two, 1)):
        sink(batch, id_)
    assert {tuple(r) for r in live.upserted(spark, str(folder / "table")).collect()} == {("a", 1, 2), ("b", 2, 1)}
    live.upserted(spark, str(folder / "table")).write.parquet(str(folder / "short/batch=-1"))
    live.upsert_sink(str(folder / "short"))(spark.createDataFrame([("b", 9, 3)], one.schema), 2)
    assert {tuple(r) for r in live.upserted(spark, str(folder / "short")).collect()} == {("a", 1, 2), ("b", 2, 3)}


def test_repeated_events_are_dropped(spark, folder):
    spark.read.parquet(str(folder / "in")).limit(5).write.mode("append").parquet(str(folder / "in"))
    query = live.unique_events(stream(spark, folder), "10 days").writeStream.format("memory").queryName("unique_events").option("checkpointLocation", str(folder / "c1")).start()
    finish(query)
    assert spark.table("unique_events").count() == 30


def test_live_averages_equal_the_batch(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = live.live_averages(stream(spark, folder)).writeStream.format("memory").queryName("live_averages").outputMode("update").option("checkpointLocation", str(folder / "c2")).start()
    finish(query)
    last = {}
    for r in spark.table("live_averages").collect():
        if r["entries"] >= last.get(r["component_id"], (0, 0))[0]:
            last[r["component_id"]] = (r["entries"], r["average"])
    batch = decayed_average(spark.read.parquet(str(folder / "in")), "component_id", F.lit("2024-01-02").cast("timestamp"))
    for r in batch.collect():
        assert last[r["component_id"]] == (r["entries"], pytest.approx(r["average"]))


def test_silent_components_are_forgotten(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2024, 1, 1)
    for hour, name in ((0, "a"), (1, "b"), (30, "b"), (31, "b"), (32, "a")):
        spark.createDataFrame([(hour, name, 0.5, start + timedelta(hours=hour))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = live.live_averages(stream(spark, tmp_path), forget_after_minutes=120, delay="1 minute").writeStream.format("memory").queryName("forgetful").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    finish(query)
    seen = [(r["component_id"], r["entries"], r["average"]) for r in spark.table("forgetful").collect()]
    assert ("a", 0, None) in seen  # forgotten in the meantime, and known again since
    assert seen.count(("a", 1, 0.5)) == 2 and ("a", 2, 0.5) not in seen
