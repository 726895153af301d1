"""Substring search by rare words and grams equals a product."""

import random

import pytest

from ctxloom.operators import filters, lexical, substring
from ctxloom.plans import more_queries as queries


def test_holding_equals_a_product(spark):
    pick = random.Random(2)
    letters = "abcé "
    texts = [(i, "".join(pick.choice(letters) for _ in range(pick.randrange(40)))) for i in range(150)] + [(200, None), (201, ""), (202, "a\tb  c d"), (203, "x" * 5000 + " abc")]
    needles = [(i, "".join(pick.choice(letters) for _ in range(pick.randrange(1, 9)))) for i in range(120)] + [(300, None), (301, ""), (302, "  "), (303, "\tb  c "), (304, "b c"), (305, "x" * 400), (306, "a b c d e f"), (307, "zz")]
    found = substring.holding(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted((n, t) for n, needle in needles if needle and needle.strip() for t, text in texts if text is not None and needle in text)


def test_contained_equals_a_product(spark):
    words = ["the", "then", "other", "é", "ab", "aéb", "x" * 3000, "q"]
    needles = ["e", "th", "the", "hen", "é", "x" * 2999, "none", "qq", "the"]
    found = substring.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(w,) for w in [*words, *words]], "word string")).collect()
    assert sorted(map(tuple, found)) == sorted((n, w) for n in set(needles) for w in words if n in w)


def test_keyword_search_takes_the_first_in_order(spark):
    memory = spark.createDataFrame([(f"m{i}", i, f"Word{i % 7} middle tail{i}") for i in range(200, 0, -1)] + [("none", 0, None)], "id string, seq long, content string")
    asked = [(1, "ord3 absent"), (2, "AIL1"), (3, "  "), (4, None), (5, "absent"), (6, "e tail9")]
    found = filters.keyword_search(spark.createDataFrame(asked, "query_id long, query string"), memory, 5).collect()
    texts = sorted((i, f"word{i % 7} middle tail{i}") for i in range(1, 201))
    expected = [(q, f"m{i}", n) for q, query in asked for n, (i, _) in enumerate([x for x in texts if any(w in x[1] for w in (query or "").lower().split())][:5], 1)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found) == sorted(expected)


def test_a_phrase_without_inner_terms_is_found(spark):
    memory = spark.createDataFrame([("a", "They sat by the old harbourside"), ("b", "nothing"), ("c", "harbour old"), ("d", None)], "id string, content string")
    asked = spark.createDataFrame([(1, "old harbour"), (2, "harbours"), (3, None)], "query_id long, query string")
    found = {(r["query_id"], r["id"]): (r["overlap"], r["relevance"]) for r in lexical.relevance(asked, memory).collect()}
    assert found[2, "a"] == (0, pytest.approx(lexical.PHRASE_BONUS)) and found[1, "a"][0] == 1 and found[1, "a"][1] > found[1, "c"][1] - 0.6
    assert set(found) == {(1, "a"), (1, "c"), (2, "a")}


@pytest.mark.parametrize("name", ["f14_keyword_search", "a4_ranking_metrics", "p4_evaluation", "j2_lexical_relevance", "w1_rank_top_k"])
def test_no_plan_has_a_product(spark, name):
    name = name if name in queries.QUERIES else next(q for q in queries.QUERIES if q.startswith(name[:3]))
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
