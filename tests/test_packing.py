"""Packing by spans of the ranks: the plain fold's decisions, and no task with a whole query."""

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ctxloom.operators import rank


def folded(rows, most):
    """query, rank -> reason, one row after another."""
    out, state = {}, {}
    for query, place, tokens, budget, relevance, miss in sorted(rows, key=lambda r: r[:2]):
        used, chosen = state.get(query, (0, 0))
        if miss:
            reason = "required_term_miss"
        elif relevance is not None and relevance < 0.1:
            reason = "below_relevance_threshold"
        elif most is not None and chosen >= most:
            reason = "max_components"
        elif budget is not None and tokens > budget - used:
            reason = "budget_exhausted" if budget - used <= 0 else "over_budget"
        else:
            reason, state[query] = "included", (used + tokens, chosen + 1)
        out[query, place] = reason
    return out


@pytest.mark.parametrize("most", [None, 0, 1, 5])
@pytest.mark.parametrize("size", [3, 1000])
def test_spans_decide_as_the_fold_does(spark, monkeypatch, most, size):
    monkeypatch.setattr(rank, "ROUND", size)
    pick = random.Random(size)
    rows = []
    for query in range(25):
        budget = pick.choice([None, -1, 0, 1, 7, 30, 400])
        rows += [(query, n, pick.choice([0, 0, 1, 1, 2, 5, 9, 60]), budget, pick.choice([None, 0.05, 0.5, 0.9]), pick.random() < 0.1) for n in range(1, pick.randrange(2, 40))]
    df = spark.createDataFrame([(q, f"i{n}", n, t, b, r, 0.1, m) for q, n, t, b, r, m in rows], "query_id long, id string, rank int, tokens int, token_budget int, relevance double, min_relevance double, required_miss boolean").repartition(5)
    found = rank.pack(df, max_components=most).collect()
    assert {(r["query_id"], r["rank"]): r["reason"] for r in found} == folded(rows, most)
    assert all(r["included"] == (r["reason"] == "included") and r["summary"] is None for r in found) and len(found) == len(rows)
    assert rank.pack(df.limit(0), max_components=most).count() == 0


def most_read(spark, work):
    """The most rows that any task of `work` read from a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def tasks(stage):
        try:
            found = store.taskList(stage, store.lastStageAttempt(stage).attemptId(), 100_000)
        except Py4JJavaError:
            return None  # no such stage
        return [found.apply(i) for i in range(found.size())]

    def last():
        n = 0
        while n < 20_000 and any(tasks(i) is not None for i in range(n, n + 50)):
            n += 50
        return n

    start = last()
    work()
    reads = [0]
    for stage in range(max(0, start - 50), last()):
        for task in tasks(stage) or ():
            metrics = task.taskMetrics()
            if metrics.isDefined():
                reads.append(metrics.get().shuffleReadMetrics().recordsRead())
    return max(reads)


def test_no_task_holds_a_query_of_a_million_rows(spark):
    n = 1_000_000
    table = spark.range(0, n, 1, 16).select(F.lit(1).alias("query_id"), F.concat(F.lit("i"), "id").alias("id"), (F.col("id") + 1).cast("int").alias("rank"), (1 + F.col("id") * 7919 % 97 + F.when(F.col("id") < 500_000, 50).otherwise(0)).cast("int").alias("tokens"), F.lit(20_000).alias("token_budget"), F.lit(0.9).alias("relevance"), F.lit(0.1).alias("min_relevance"), F.lit(False).alias("required_miss"))
    out = {}
    # as on large tables: nothing is broadcast, and AQE splits what is skewed
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", f"{skew}ThresholdInBytes": "4k", f"{skew}Factor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def work():
            packed = rank.pack(table)
            out.update((r["reason"], (r["n"], r["t"])) for r in packed.groupBy("reason").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect())

        # AQE can split a key down to what one of the 4 tasks before the shuffle wrote
        assert rank.ROUND <= most_read(spark, work) <= n // 4 + rank.ROUND
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    used, counts = 0, {"included": 0, "over_budget": 0, "budget_exhausted": 0}
    for i in range(n):
        tokens = 1 + i * 7919 % 97 + (50 if i < 500_000 else 0)
        if used + tokens <= 20_000:
            used, reason = used + tokens, "included"
        else:
            reason = "budget_exhausted" if used >= 20_000 else "over_budget"
        counts[reason] += 1
    assert {k: v[0] for k, v in out.items()} == {k: v for k, v in counts.items() if v} and out["included"][1] == used


def test_rows_decided_early_carry_no_terms(spark):
    rows = spark.range(2000).select(F.lit(1).alias("query_id"), "id", (F.col("id") + 1).alias("rank"), F.lit(5).alias("tokens"), F.lit(20).alias("token_budget"), F.when(F.col("id") % 500 == 0, 1.0).otherwise(0.0).alias("relevance"), F.lit(0.5).alias("min_relevance"), F.lit(False).alias("required_miss"))
    # terms that must not be read: an error where a row is left out by its relevance
    terms = F.when(F.col("relevance") > 0, F.array(F.concat(F.lit("w"), F.col("id").cast("string")))).otherwise(F.raise_error(F.lit("read")).cast("array<string>"))
    found = rank.pack(rows.withColumn("terms", terms), redundancy=0.9)
    assert {r["id"] for r in found.where("included").collect()} == {0, 500, 1000, 1500}
    assert found.where("reason = 'below_relevance_threshold'").count() == 1996
