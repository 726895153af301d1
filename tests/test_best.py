"""The best memories by bounds on postings equal the ranking of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import best, lexical, rank

MEMORY = "id string, seq long, content string, importance double, recency double"


def ranked(queries, memory, k, weights=rank.WEIGHTS):
    zero = F.lit(0.0)
    rows = memory.select("id", "seq", F.coalesce("importance", zero).alias("importance"), F.coalesce("recency", zero).alias("recency"))
    pairs = lexical.relevance(queries, memory).join(rows, "id")
    scored = pairs.withColumn("score", F.round(rank.score(F.col("relevance"), F.col("importance"), F.col("recency"), F.lit(True), weights), 9))
    return rank.top_k(scored, k)


def table(spark, n=250, seed=5):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(200)]

    def content():
        return " ".join(words[min(199, int(pick.expovariate(0.03)))] for _ in range(pick.choice([1, 3, 8, 30, 120])))

    rows = [(f"m{i}", i, content(), pick.choice([0.0, 0.3, 1.0, 2.2, None]), pick.choice([0.0, 0.5, 1.0])) for i in range(n)]
    rows += [(f"copy{i}", 1000 + i, "w0 w1 w2 same", 1.0, 0.0) for i in range(60)]
    rows += [("null", 2000, None, 1.0, 1.0), ("empty", 2001, "", 1.0, 1.0), ("stop", 2002, "the of and", 2.0, 1.0), ("in", 2003, "the harbourside w1", None, None), ("long", 2004, " ".join(words * 300), 1.0, 1.0)]
    asked = [(i, " ".join(words[min(199, int(pick.expovariate(0.03)))] for _ in range(pick.choice([1, 2, 6, 20])))) for i in range(20)]
    asked += [(100, rows[3][2]), (101, "w0 w1 w2"), (102, None), (103, ""), (104, "the"), (105, "harbour"), (106, "absent words"), (107, "absent w5")]
    return spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(rows, MEMORY)


@pytest.mark.parametrize("k,weights", [(5, rank.WEIGHTS), (10000, rank.WEIGHTS), (50, {"relevance": 0.0, "importance": 2.0, "recency": 1.0})])
def test_best_equals_the_ranking_of_all_pairs(spark, k, weights):
    asked, memory = table(spark)
    columns = ["query_id", "rank", "id", F.round("score", 8), F.round("relevance", 8)]
    found = best.best(asked, memory, k, weights=weights).select(*columns).collect()
    assert found and sorted(map(tuple, found)) == sorted(map(tuple, ranked(asked, memory, k, weights).select(*columns).collect()))


def test_few_pairs_are_scored(spark, monkeypatch):
    """A hundred copies of what is asked for leave no room for others, which are not scored."""
    rows = [(f"m{i}", i, " ".join(f"w{(i * j) % 97}" for j in range(40)), 0.0, 0.0) for i in range(2000)] + [(f"c{i}", 5000 + i, "w1 w2 w3 w4 rare", 0.0, 0.0) for i in range(100)]
    memory, asked = spark.createDataFrame(rows, MEMORY), spark.createDataFrame([(1, "w1 w2 w3 w4 rare")], "query_id long, query string")
    written = {}
    keep = best.materialise
    monkeypatch.setattr(best, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    found = best.best(asked, memory, 10).collect()
    assert sorted(r["id"] for r in found) == [f"c{i}" for i in range(10)]
    assert written["possible"].count() <= 100 < lexical.relevance(asked, memory).count() / 10


def test_nothing_to_search(spark):
    asked, memory = table(spark, 20)
    assert best.best(asked, memory.limit(0), 5).count() == best.best(asked.limit(0), memory, 5).count() == 0
