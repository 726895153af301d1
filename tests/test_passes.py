"""Relevance and retrieval by passes of a bounded number of queries, and summaries by rounds."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import lexical, rank, substring
from ctxloom.plans import pipelines

WORDS = [f"word{i}" for i in range(30)]


def memories(spark, n=60):
    pick = random.Random(3)
    rows = [(f"m{i}", i, pick.choice(["LongTermMemoryComponent", "TaskSummaryComponent"]), pick.sample(["a", "b", "c", None], 2), "active", None, pick.random(), " ".join(pick.choices(WORDS, k=pick.randrange(0, 12))), None) for i in range(n)]
    rows[1] = rows[1][:7] + ("xword1 word2x", None)
    rows[2] = rows[2][:7] + (None, None)
    return spark.createDataFrame(rows, "id string, seq long, type string, tags array<string>, status string, expires timestamp, score double, content string, ts timestamp")


def requests(spark):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(WORDS, k=4)), pick.choice([["a"], ["a", "b"], [None], []]), pick.choice([["word1 word3"], ["the"], [], None])) for i in range(9)]
    rows += [(9, "word1 word2", ["b", "c"], []), (10, None, [], ["word4"]), (11, "?", [], []), (12, "the", ["a"], [])]
    return spark.createDataFrame(rows, "query_id long, query string, include_tags array<string>, required_terms array<string>")


def found(df):
    return sorted(map(repr, df.collect()))


def test_pairs_are_not_shuffled_and_passes_add_up(spark, monkeypatch):
    asked, memory = requests(spark), memories(spark)
    once = lexical.relevance(asked, memory, ["seq"])
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert {(9, "m1")} <= {(r["query_id"], r["id"]) for r in once.where("overlap = 0").collect()}
    whole = found(once)
    monkeypatch.setattr(lexical, "QUERIES_PER_PASS", 2)
    monkeypatch.setattr(lexical, "CELLS", 7)
    assert found(lexical.relevance(asked, memory, ["seq"])) == whole


@pytest.mark.parametrize("rejected", [True, False])
def test_retrieval_is_the_same_in_one_pass_and_in_many(spark, monkeypatch, rejected):
    asked, memory = requests(spark), memories(spark)
    log = spark.createDataFrame([("m3", "TaskSummaryComponent", 1.0, datetime(2024, 1, 1))], "component_id string, component_type string, score double, ts timestamp")
    as_of = F.lit(datetime(2024, 1, 2))
    once = pipelines.retrieve(memory, asked, log, as_of, rejected=rejected)
    whole = found(once)
    pairs = [(r["query_id"], r["id"]) for r in once.collect()]
    assert len(pairs) == len(set(pairs)) and (not rejected or len(pairs) == 13 * 60)
    monkeypatch.setattr(pipelines, "REQUESTS_PER_PASS", 3)
    assert found(pipelines.retrieve(memory, asked, log, as_of, rejected=rejected)) == whole
    # the general way of a scorer that a caller gives
    assert found(pipelines.retrieve(memory, asked, log, as_of, rejected=rejected, scorer=lambda q, m: lexical.relevance(q, m))) == whole
    some = found(pipelines.retrieve(memory, asked, log, as_of, rejected=rejected, only_included=True))
    assert some == found(once.where("included"))


@pytest.mark.parametrize("most", [None, 0, 3])
def test_summaries_by_rounds_decide_as_the_stream_does(spark, monkeypatch, most):
    monkeypatch.setattr(rank, "FIRST_ROUND", 2)
    monkeypatch.setattr(rank, "GROWTH", 2)
    pick = random.Random(7)
    rows = [(q, f"i{n}", n, size, budget, pick.choice([0.0, 0.5]), 0.1, False, " ".join(["w"] * size) if pick.random() < 0.8 else None) for q in range(20) for budget in [pick.choice([None, -1, 0, 5, 40])] for n in range(1, pick.randrange(2, 40)) for size in [pick.choice([0, 1, 2, 9])]]
    df = spark.createDataFrame(rows, "query_id long, id string, rank int, tokens int, token_budget int, relevance double, min_relevance double, required_miss boolean, content string").withColumn("terms", F.array("id"))
    short = {"summarize": lambda t, n: t[: n], "max_components": most}
    stream = found(rank.pack(df, redundancy=2.0, **short))
    assert found(rank.pack(df, **short)) == stream
    keyed = df.withColumn("id", F.concat_ws("-", "query_id", "id"))
    stream = found(rank.pack(keyed, redundancy=2.0, **short))
    assert found(rank.pack(keyed.drop("content"), contents=keyed.select("id", "content"), **short)) == stream


def test_contents_behind_a_spent_budget_are_not_read(spark, monkeypatch):
    written = {}

    def kept(df, name, write=rank.materialise):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(rank, "materialise", kept)
    rows = spark.range(1, 5001).select(F.lit(1).alias("query_id"), "id", F.col("id").alias("rank"), F.lit(5).alias("tokens"), F.lit(50).alias("token_budget"), F.lit(1.0).alias("relevance"), F.lit(0.0).alias("min_relevance"), F.lit(False).alias("required_miss"), F.lit("a b c d e").alias("content"))
    out = rank.pack(rows, summarize=lambda t, n: t)
    assert {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()} == {"included": 10, "budget_exhausted": 4990}
    assert [df.count() for df in written["packed"]] == [rank.FIRST_ROUND]


def test_scanned_finds_what_holding_finds_in_any_number_of_passes(spark, monkeypatch):
    needles = spark.createDataFrame([(1, "ab c"), (2, "b"), (3, " "), (4, ""), (5, None), (6, "ab c"), (7, "ñ a"), (8, "no")], "needle_id long, needle string")
    texts = spark.createDataFrame([(1, "xab cd"), (2, "b"), (3, None), (4, ""), (5, "dañ ab c"), (6, "B")], "text_id long, text string")
    whole = {(1, 1), (6, 1), (2, 1), (2, 2), (1, 5), (6, 5), (2, 5), (7, 5)}
    assert {tuple(r) for r in substring.holding(needles, texts).collect()} == whole
    once = substring.scanned(needles, texts)
    assert [tuple(r) for r in once.collect() if tuple(r) not in whole] == [] and once.count() == len(whole)
    monkeypatch.setattr(substring, "NEEDLES_PER_PASS", 1)
    assert {tuple(r) for r in substring.scanned(needles, texts).collect()} == whole
    assert substring.scanned(needles.limit(0), texts).count() == 0
