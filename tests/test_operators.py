"""Semantics that the tables don't show, on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import scores, text
from ctxloom.operators import audit, consolidate, evaluate, exact, filters, rank, select, stats, vectors
from ctxloom.plans import pipelines
from ctxloom.sources import tables


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def ranked(spark, rows, budget=10):
    names = "query_id long, id string, rank int, tokens int, token_budget int, relevance double, min_relevance double, required_miss boolean, terms array<string>, content string"
    return spark.createDataFrame([(1, id_, n, tokens, budget, rel, 0.1, miss, terms, " ".join(terms)) for n, (id_, tokens, rel, miss, terms) in enumerate(rows, 1)], names)


def reasons(df):
    return {r["id"]: r["reason"] for r in df.collect()}


def test_packing_goes_on_after_a_row_that_does_not_fit(spark):
    rows = [("a", 6, 1.0, False, ["x"]), ("b", 6, 1.0, False, ["y"]), ("c", 4, 1.0, False, ["z"]), ("d", 1, 1.0, False, ["w"]), ("e", 1, 0.0, False, ["v"]), ("f", 1, 0.0, True, ["u"])]
    assert reasons(rank.pack(ranked(spark, rows))) == {"a": "included", "b": "over_budget", "c": "included", "d": "budget_exhausted", "e": "below_relevance_threshold", "f": "required_term_miss"}


def test_packing_tests_redundancy_before_the_number_of_rows(spark):
    rows = [("a", 1, 1.0, False, ["x", "y"]), ("b", 1, 1.0, False, ["y", "x"]), ("c", 1, 1.0, False, ["z"])]
    assert reasons(rank.pack(ranked(spark, rows), max_components=1, redundancy=0.88)) == {"a": "included", "b": "redundant", "c": "max_components"}


def test_packing_summarises_into_what_is_left(spark):
    rows = [("a", 8, 1.0, False, ["x"] * 8), ("b", 9, 1.0, False, ["y"] * 9)]
    out = {r["id"]: r for r in rank.pack(ranked(spark, rows), summarize=lambda t, n: t).collect()}
    assert out["b"]["reason"] == "included_summarized" and out["b"]["tokens"] == 2


def test_equal_scores_keep_their_order(spark):
    df = spark.createDataFrame([(1, "b", 2, 0.5), (1, "a", 1, 0.5), (1, "c", 3, 0.9)], "query_id long, id string, seq long, score double")
    assert [r["id"] for r in rank.rank(df).orderBy("rank").collect()] == ["c", "a", "b"]


def test_importance_is_held_only_with_a_query(spark):
    none = F.lit(0.0)
    assert one(spark, rank.score(none, F.col("i"), none, F.lit(True)), i=3.0) == pytest.approx(0.25)
    assert one(spark, rank.score(none, F.col("i"), none, F.lit(False)), i=3.0) == 3.0


def test_expiry_outranks_status_and_a_missing_expiry_never_comes(spark):
    row = {c: F.col(c) for c in ("id", "type", "tags", "status", "expires", "include_tags", "tag_mode", "types", "task_id", "include_inactive")}
    schema = "id string, type string, tags array<string>, status string, expires timestamp, include_tags array<string>, tag_mode string, types array<string>, task_id string, include_inactive boolean"
    from datetime import datetime

    old, now = datetime(2024, 1, 1), F.lit("2024-02-01").cast("timestamp")
    made = [("1", "T", ["a"], "superseded", old, None, "any", None, None, False), ("2", "T", ["a"], "superseded", None, None, "any", None, None, False), ("3", "T", ["a"], "active", None, ["b"], "any", None, None, False), ("4", "T", ["a"], None, None, [], "all", [], None, None), ("5", "T", ["a"], "superseded", old, None, "any", None, None, True)]
    df = spark.createDataFrame(made, schema).select("id", filters.reason(row, now).alias("r"))
    assert {r["id"]: r["r"] for r in df.collect()} == {"1": "lifecycle_expired", "2": "lifecycle_superseded", "3": "tag_filter", "4": "eligible", "5": "eligible"}


def test_pool_of_one_value_is_neutral(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "g long, v double")
    assert sorted(r["normalised"] for r in rank.pool_rank(df, ["g"], "v").collect()) == [0.0, 0.5, 0.5, 1.0]


def test_weights(spark):
    with pytest.raises(ValueError):
        scores.hybrid(*[F.lit(0.0)] * 5, weights={"semantic": -1, "importance": 1, "recency": 0, "feedback": 0})


def test_metrics_with_empty_denominators(spark):
    results = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 2, 1)], "query_id long, id string, rank int, tokens int")
    labels = spark.createDataFrame([(1, "a", 1.0), (1, "c", 2.0)], "query_id long, id string, gain double")
    excluded = spark.createDataFrame([(1, "b")], "query_id long, id string")
    cases = spark.createDataFrame([(1,), (2,)], "query_id long")
    out = {r["query_id"]: r for r in evaluate.ranking_metrics(results, labels, excluded, cases, 0).collect()}
    assert (out[1]["precision"], out[1]["recall"], out[1]["mrr"]) == (0.5, 0.5, 1.0)
    assert out[1]["token_efficiency"] == pytest.approx(2 / 3) and out[1]["exclusion_accuracy"] == 0.0
    assert tuple(out[2])[1:] == (0.0, 1.0, 0.0, 1.0, 0.0, 1.0)


def test_register_policies(spark):
    table = spark.createDataFrame([("a", 1, 0)], "id string, seq long, version long")
    new = spark.createDataFrame([("a", 5, 1), ("b", 6, 1)], table.schema)
    assert {tuple(r) for r in tables.register(table, new, "skip").collect()} == {("a", 1, 0), ("b", 6, 1)}
    assert {tuple(r) for r in tables.register(table, new, "replace").collect()} == {("a", 1, 1), ("b", 6, 1)}
    with pytest.raises(ValueError):
        tables.register(table, new, "error")
    with pytest.raises(ValueError):
        tables.register(table, spark.createDataFrame([("", 1, 1)], table.schema), "skip")


def test_append_evidence_numbers_on_and_rejects_repeats(spark):
    log = spark.createDataFrame([(7, "run", "1", "p", "h")], "sequence long, record_type string, record_id string, payload_json string, payload_hash string")
    new = spark.createDataFrame([("run", "3", "x"), ("run", "2", "y")], "record_type string, record_id string, payload_json string")
    assert {(r["record_id"], r["sequence"]) for r in tables.append_evidence(log, new).collect()} == {("2", 8), ("3", 9)}
    with pytest.raises(ValueError):
        tables.append_evidence(log, spark.createDataFrame([("run", "1", "x")], new.schema))


def test_reads_memory_and_feedback(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": "a", "type": "T", "tags": ["x"], "content": "c", "score": 1.5, "memory": {"status": "active"}}]')
    assert tables.read_memory(spark, str(tmp_path / "m.json")).first()["memory"]["status"] == "active"
    (tmp_path / "f.json").write_text('{"a": [0.5, {"score": 1.0, "component_type": "T", "timestamp": "2024-01-01T00:00:00"}]}')
    assert {(r["score"], r["component_type"]) for r in tables.read_feedback(spark, str(tmp_path / "f.json")).collect()} == {(0.5, "Unknown"), (1.0, "T")}


def test_derive_reports_violations(spark):
    memory = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, content string")
    commands = spark.createDataFrame([("m", None, ["b", "a"], True), ("n", "x", [], False), ("o", "x", ["z"], False), ("a", "x", ["b"], False), ("p", " ", ["a"], False)], "new_id string, content string, source_ids array<string>, supersede boolean")
    made, bad = consolidate.derive(memory, commands)
    assert [(r["new_id"], r["content"]) for r in made.collect()] == [("m", "B\n\nA")]
    assert {tuple(r) for r in bad.collect()} == {("n", "no_sources"), ("o", "unknown_source"), ("a", "id_exists"), ("p", "blank_content")}


def test_resolve(spark):
    memory = spark.createDataFrame([("a", "active", [], ["b", "c"]), ("b", "active", ["x"], ["a"])], "id string, status string, supersedes_ids array<string>, contradiction_ids array<string>")
    out = {r["id"]: r for r in consolidate.resolve(memory, spark.createDataFrame([("a", "b")], "winner string, loser string")).collect()}
    assert out["b"]["status"] == "superseded" and out["a"]["supersedes_ids"] == ["b"]
    assert out["a"]["contradiction_ids"] == ["c"] and out["b"]["contradiction_ids"] == []


def test_holm_stops_at_the_first_failure(spark):
    out = {r["name"]: r for r in stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")).collect()}
    assert [out[n]["rejected"] for n in "abc"] == [True, False, False]
    assert out["b"]["adjusted"] == pytest.approx(0.06)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_spans_of_the_order_give_the_same_ranks(spark, by):
    rows = [(None if i % 5 == 0 else f"g{i % 2}", f"n{i}", (i * 37 % 101) / 4000, i % 7) for i in range(300)]
    tests = spark.createDataFrame(rows, "g string, name string, p double, v int")
    plain = {r["name"]: tuple(r) for r in stats.holm(tests, by=by, few=True).collect()}
    assert {r["name"]: tuple(r) for r in stats.holm(tests, by=by).collect()} == plain and len(plain) == 300
    assert {x[-1] for x in plain.values()} == {True, False}
    groups = {}
    for g, _, p, v in rows:
        groups.setdefault(g if by else None, []).append((p, v))
    for share in (0.0, 0.9):
        found = {r["g"] if by else None: r["percentile"] for r in stats.weighted_nearest_rank(tests, by, "p", "v", share).collect()}
        for g, own in groups.items():
            own.sort()
            assert found[g] == next(p for i, (p, _) in enumerate(own) if sum(v for q, v in own if q <= p) >= share * sum(v for _, v in own) - 1e-9)


def test_features(spark):
    made = spark.createDataFrame([("scope:local",), ("tag:gold",), ("x:y",), ("Tag:y",), ("tag:a-id",)], "f string").select("f", audit.feature_reason(F.col("f")).alias("r"))
    assert {r["f"]: r["r"] for r in made.collect()} == {"scope:local": None, "tag:gold": "reserved_vocabulary", "x:y": "namespace", "Tag:y": "grammar", "tag:a-id": "identity_vocabulary"}


def test_embedding_keeps_rows_that_fail(spark):
    docs = spark.createDataFrame([("a b",), ("c",)], "t string")
    assert all(len(r["embedding"]) == 32 for r in vectors.embed(docs, "t").collect())

    def broken(texts, dimension):
        raise RuntimeError("down")

    assert [r["error"] for r in vectors.embed(docs, "t", provider=broken).collect()] == ["down", "down"]


def test_text_edges(spark):
    assert one(spark, text.truncate_tokens(F.col("t"), F.lit(0)), t="a b") == ""
    assert one(spark, text.token_count(F.col("t")), t="a b") == 2
    assert one(spark, text.slugify(F.col("t")), t="!!") == "research-project"
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0), t="") == 1.0


def test_resampled_means_of_groups_beyond_a_long(spark):
    from collections import Counter

    groups = {1: [0, 1, 3], 2: [k % 3 for k in range(18)]}
    rows = [(g, i, x) for g, own in groups.items() for i, x in enumerate(own)]
    out = exact.resampled_means(spark.createDataFrame(rows, "g long, index long, value long"), ["g"]).collect()
    for g, own in groups.items():
        sums = Counter({0: 1})
        for _ in own:
            new = Counter()
            for total, ways in sums.items():
                for x in own:
                    new[total + x] += ways
            sums = new
        assert {r["total"]: int(r["ways"]) for r in out if r["g"] == g} == sums
    with pytest.raises(OverflowError):
        exact.resampled_means(spark.createDataFrame([(1, i, 0) for i in range(27)], "g long, index long, value long"), ["g"])


def test_resampled_means_query_keeps_large_orders(spark, monkeypatch):
    from ctxloom.plans import queries

    units = spark.createDataFrame([(1, i, 25 * (i % 2)) for i in range(17)], "l_orderkey long, index long, score long")
    monkeypatch.setattr(queries, "_units", lambda v: units)
    out = queries.QUERIES["n3_resampled_means"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 18 and sum(int(r["ways"]) for r in out) == 17**17


def test_ivf_search_equals_brute_force(spark):
    from ctxloom.plans import queries

    folder = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in e]), np.array([r[1] for r in e], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for r in queries.QUERIES["j14_ivf_top"](spark, folder).collect():
        out.setdefault(r["query_id"], []).append((r["similarity"], r["id"]))
    assert set(out) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in out.items():
        own = v @ v[ids == q][0]
        true = sorted(own[ids != q], reverse=True)[:10]
        assert np.allclose(sorted((s for s, _ in found), reverse=True), true, atol=1e-6)


MEMORY = "id string, seq long, type string, tags array<string>, content string, score double, ts timestamp, status string, expires timestamp"


def remembered(spark):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    rows = [("a", "copper lanterns by the harbour", "active"), ("b", "copper mines of the north and their many long tunnels", "active"), ("c", "nothing alike", "active"), ("d", "copper copper", "superseded")]
    return spark.createDataFrame([(i, n, "LongTermMemoryComponent", ["x"], text, 1.0, day, status, None) for n, (i, text, status) in enumerate(rows)], MEMORY)


def asked(spark, budget, **more):
    from datetime import datetime

    log = spark.createDataFrame([], "component_id string, component_type string, score double, ts timestamp")
    requests = spark.createDataFrame([(1, "copper lanterns", budget)], "query_id long, query string, token_budget int")
    return pipelines.retrieve(remembered(spark), requests, log, F.lit(datetime(2024, 1, 2)), **more)


def test_retrieval_by_another_counter_does_not_cut_summaries(spark):
    out = {r["id"]: r for r in asked(spark, 40, count=len, summarize=lambda text, room: text[:12]).collect()}
    assert (out["a"]["reason"], out["a"]["tokens"]) == ("included", 30)
    assert out["b"]["reason"] == "summarization_failed_budget" and out["c"]["reason"] == "summarization_failed_budget"
    out = {r["id"]: r for r in asked(spark, 42, count=len, summarize=lambda text, room: text[:12]).collect()}
    assert (out["b"]["reason"], out["b"]["tokens"], out["b"]["summary"]) == ("included_summarized", 12, "copper mines")


def test_a_failing_hook_costs_its_row_alone(spark):
    def count(text):
        if "nothing" in text:
            raise RuntimeError("cannot count")
        return len(text.split())

    def summarize(text, room):
        if "mines" in text:
            raise RuntimeError("cannot shorten")
        return text

    out = {r["id"]: r for r in asked(spark, 6, count=count, summarize=summarize).collect()}
    assert {i: (r["reason"], r["included"], r["tokens"]) for i, r in out.items() if i != "d"} == {"a": ("included", True, 5), "b": ("processing_error", False, 0), "c": ("processing_error", False, 0)}
    out = {r["id"]: r for r in asked(spark, 6, count=count).collect()}
    assert {i: (r["reason"], r["tokens"]) for i, r in out.items() if i != "d"} == {"a": ("included", 5), "b": ("over_budget", 10), "c": ("processing_error", 0)}


def test_a_judge_is_held_to_its_range_and_its_errors_are_no_relevance(spark):
    def judge(query, content):
        return {"copper l": 7.0, "copper m": float("nan"), "nothing ": -3.0}[content[:8]] if "mines" not in content else 1 / 0

    out = {r["id"]: r for r in asked(spark, None, judge=judge).collect()}
    assert [out[i]["rank"] for i in ("a", "b", "c")] == [1, 2, 3] and all(out[i]["reason"] == "included" for i in ("a", "b", "c"))

    def scorer(requests, memory):
        values = F.create_map(F.lit("a"), F.lit(-5.0), F.lit("b"), F.lit(float("nan")), F.lit("c"), F.lit(9.0), F.lit("d"), F.lit(1.0))
        return requests.select("query_id").join(memory.select("id"), F.lit(True)).withColumn("relevance", values[F.col("id")])

    assert [r["id"] for r in asked(spark, None, scorer=scorer).where("rank is not null").orderBy("rank").collect()] == ["c", "a", "b"]


def test_retrieval_by_another_scorer_and_a_summary_that_knows_the_query(spark):
    def scorer(requests, memory):
        return requests.select("query_id").join(memory.where("id = 'c'").select("id"), F.lit(True)).withColumn("relevance", F.lit(1.0))

    out = {r["id"]: r for r in asked(spark, 2, scorer=scorer, summarize=lambda text, room, query: f"{query} {text}").collect()}
    assert out["c"]["rank"] == 1 and out["c"]["reason"] == "included"
    out = {r["id"]: r for r in asked(spark, 3, summarize=lambda text, room, query: f"{query}: {text}").collect()}
    assert out["a"]["summary"] == "copper lanterns: copper"


def test_retrieval_without_rejected_rows_keeps_the_same_decisions(spark):
    whole = {(r["id"], r["reason"]) for r in asked(spark, 6).collect()}
    assert ("d", "lifecycle_superseded") in whole
    assert {(r["id"], r["reason"]) for r in asked(spark, 6, rejected=False).collect()} == {x for x in whole if x[0] != "d"}


def test_context_joins_contents_of_included_rows(spark):
    found = pipelines.context(asked(spark, 8, rejected=False), remembered(spark)).first()
    assert found["context"].split("\n\n") == ["copper lanterns by the harbour", "nothing alike"] and found["used_tokens"] == 7


def test_an_unknown_tag_mode_is_an_error(spark):
    df = spark.createDataFrame([(["a"], ["a"], "some")], "tags array<string>, wanted array<string>, mode string")
    with pytest.raises(Exception, match="unknown tag mode"):
        df.select(filters.tag_match(F.col("tags"), F.col("wanted"), F.col("mode"))).collect()


def test_permutations_of_a_larger_group(spark):
    from itertools import combinations
    from math import comb

    scores = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    rows = [(1, i, i % 3 == 0, x) for i, x in enumerate(scores)] + [(2, i, i < 20, 1) for i in range(40)]
    out = {r["g"]: r for r in exact.permutation_p(spark.createDataFrame(rows, "g int, index int, treated boolean, score long"), ["g"]).collect()}
    seen = sum(x for i, x in enumerate(scores) if i % 3 == 0)
    assert out[1]["p"] == pytest.approx(sum(sum(c) >= seen for c in combinations(scores, 4)) / comb(12, 4)) and out[1]["combinations"] == comb(12, 4)
    assert (out[2]["p"], out[2]["combinations"]) == (1.0, comb(40, 20))


def test_interval_of_a_difference_equals_all_resamples(spark):
    from itertools import product

    left, right = [3, 7, 8], [1, 2, 6, 6]
    values = [spark.createDataFrame([("g", i, x) for i, x in enumerate(side)], "g string, index int, value long") for side in (left, right)]
    found = exact.resampled_interval(*values, ["g"]).first()
    every = sorted(sum(a) / 3 - sum(b) / 4 for a in product(left, repeat=3) for b in product(right, repeat=4))
    n = len(every)
    assert found["low"] == pytest.approx(every[-(-25 * n // 1000) - 1]) and found["high"] == pytest.approx(every[-(-975 * n // 1000) - 1])


def test_numbers_of_a_large_group_are_gapless(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 20011).alias("at"))
    out = rank.numbered(df, "g", "at", "n").toPandas()
    for _, group in out.groupby("g"):
        assert list(group.sort_values("at").n) == list(range(len(group)))


def test_numbers_of_all_rows_follow_the_order_across_spans(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, (F.col("id") * 7 % 3001).cast("string")).alias("k"), "id")
    span = rank.spans(df, ["k", "id"], 16)
    assert 8 < df.select(span).distinct().count() <= 16
    found = [(r["k"], r["id"]) for r in sorted(rank.numbered_in_spans(df, [], ["k", "id"], span, "n").collect(), key=lambda r: r["n"])]
    assert found == sorted(found, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert rank.numbered_in_spans(df.limit(0), [], ["k"], rank.spans(df.limit(0), ["k"]), "n").count() == 0


def test_experiment_finds_arms_that_saw_other_items(spark):
    cases = spark.createDataFrame([(1, "f", 1, "copper", 9), (2, "f", 2, "copper", 9)], "case_id long, family_id string, ordinal long, prompt string, token_budget int")
    items = spark.createDataFrame([(c, p, f"i{c}{p}", "copper text", 2, 0.5, {"format": ["format:note"]}) for c in (1, 2) for p in (0, 1)], "case_id long, pos long, item_id string, content string, token_count int, confidence double, metadata map<string, array<string>>")
    rewards = spark.createDataFrame([("f", 0, "format:note", 1.0), ("f", 0, "format:note", 0.5), ("f", 1, "format:note", 1.0)], "family_id string, ordinal long, target string, reward double")
    known = {(r["case_id"], r["utility"]) for r in select.prefix_utilities(cases, rewards).collect()}
    assert known == {(1, 1.5 / 4), (2, 2.5 / 5)}
    selections, violations = pipelines.experiment(cases, items, rewards, {"confidence": 1.0}, 3)
    assert selections.count() == 4 * 4 * 3 and violations.isEmpty()


def test_feedback_is_appended_and_out_of_range_is_an_error(spark, tmp_path):
    entry = spark.sql("SELECT 'a' AS component_id, 'T' AS component_type, 0.5D AS score, timestamp'2024-01-01' AS ts")
    for _ in range(2):
        tables.append_feedback(entry, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        tables.append_feedback(entry.withColumn("score", F.lit(2.0)), str(tmp_path / "log"))


def test_broken_memory_records_are_told(spark):
    out = tables.parse_memory(spark.createDataFrame([('{"id": "a", "score": 1}',), ("{broken",), (None,)], "record string")).collect()
    assert [(r["id"], r["error"]) for r in out] == [("a", None), (None, "broken record"), (None, "broken record")]
