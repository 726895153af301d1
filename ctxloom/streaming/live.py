"""Live decayed feedback, idempotent upserts and duplicate-free event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.tables import upsert


class DecayedAverage(StatefulProcessor):
    """State: the weighted sums as of the newest event; the ratio doesn't depend on when it is read.

    With `forget_seconds`, a component is forgotten once the watermark is so far beyond its newest event.
    """

    def __init__(self, half_life_minutes: float = 60.0, forget_seconds: float | None = None) -> None:
        self.half_life, self.forget = half_life_minutes * 60.0, forget_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sums", "weighted double, weight double, entries long, anchor double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        weighted, weight, entries, anchor = self.state.get() if self.state.exists() else (0.0, 0.0, 0, None)
        for frame in rows:
            at = frame["ts"].astype("int64") / {"ns": 1e9, "us": 1e6}.get(getattr(frame["ts"].dtype, "unit", "ns"), 1e9)
            newest = float(at.max()) if anchor is None else max(anchor, float(at.max()))
            if anchor is not None:
                shrink = 0.5 ** ((newest - anchor) / self.half_life)
                weighted, weight = weighted * shrink, weight * shrink
            own = 0.5 ** ((newest - at) / self.half_life)
            weighted, weight, entries, anchor = weighted + float((own * frame["score"]).sum()), weight + float(own.sum()), entries + len(frame), newest
        self.state.update((weighted, weight, entries, anchor))
        if self.forget is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # a batch of late events alone must not set a timer that is over already
            self.handle.registerTimer(max(int((anchor + self.forget) * 1000), timer_values.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"component_id": [key[0]], "average": [weighted / weight if weight > 0 else 0.0], "entries": [entries]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"component_id": [key[0]], "average": [None], "entries": [0]}).astype({"average": "float64"})

    def close(self) -> None:
        pass


def live_averages(events: DataFrame, half_life_minutes: float = 60.0, forget_after_minutes: float | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of (component_id, average, entries) after each batch.

    Without `forget_after_minutes` late events only weigh less, and every component stays. With it,
    a component is forgotten when the watermark (`delay` behind the newest event of all) is so many
    minutes beyond its own newest event; it then gives a row with a null average and no entries, and
    events later than the watermark are left out.
    """
    out = {"outputStructType": "component_id string, average double, entries long", "outputMode": "Update"}
    if forget_after_minutes is None:
        return events.groupBy("component_id").transformWithStateInPandas(statefulProcessor=DecayedAverage(half_life_minutes), timeMode="None", **out)
    forgetful = DecayedAverage(half_life_minutes, forget_after_minutes * 60.0)
    return events.withWatermark("ts", delay).groupBy("component_id").transformWithStateInPandas(statefulProcessor=forgetful, timeMode="EventTime", **out)


def upsert_sink(path: str):
    """For foreachBatch: each batch adds its last writes to the log at `path`; a batch that comes again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.limit(0), batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that the log of upsert_sink() stands for. Written as batch=-1 of a new path, it is where a shorter log begins."""
    rows = spark.read.parquet(path).drop("batch")
    return upsert(rows.limit(0), rows)


def unique_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of an id inside the delay, each with the rules that it breaks."""
    rules = F.array_compact(F.array(F.when(F.col("score").isNull(), "score_missing"), F.when(F.abs("score") > 1, "score_range"), F.when(F.col("component_id") == "", "component_missing")))
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("violations", rules)
