"""Evaluation sets and bundles from JSON."""

import json

import pytest

from ctxloom.sources import bundles


def test_evaluation_set(spark, tmp_path):
    made = {"name": "n", "cases": [{"id": "q", "query": "x", "relevant_ids": ["a", "b"], "excluded_ids": ["z"], "relevance": {"a": 3.0, "c": 2.0}}]}
    (tmp_path / "e.json").write_text(json.dumps(made))
    cases, labels, excluded = bundles.read_evaluation(spark, str(tmp_path / "e.json"))
    assert cases.count() == 1 and excluded.first()["id"] == "z"
    assert {(r["id"], r["gain"], r["relevant"]) for r in labels.collect()} == {("a", 3.0, True), ("b", 1.0, True), ("c", 2.0, False)}


def test_bundle_keeps_places_and_rejects_other_versions(spark, tmp_path):
    item = {"context_item_id": "i", "content": "c", "token_count": 1, "confidence": 0.5, "metadata": {"format": ["format:note"]}}
    case = {"case_id": "c", "family_id": "f", "split": "adaptation", "candidates": [item, item | {"context_item_id": "j"}], "labels": {"required": ["j"], "useful": [], "misleading": ["i"]}}
    for version in ("3", "1"):
        (tmp_path / f"{version}.json").write_text(json.dumps({"schema_version": version, "cases": [case]}))
    _, candidates, labels = bundles.read_bundle(spark, str(tmp_path / "3.json"))
    assert [(r["pos"], r["item_id"]) for r in candidates.orderBy("pos").collect()] == [(0, "i"), (1, "j")]
    assert {(r["item_id"], r["label"]) for r in labels.collect()} == {("j", "required"), ("i", "misleading")}
    with pytest.raises(ValueError):
        bundles.read_bundle(spark, str(tmp_path / "1.json"))


def test_records(spark):
    rows = spark.createDataFrame([("a", "T", ["t"], "c", 1.0, "s")], "id string, type string, tags array<string>, content string, score double, source string")
    record = json.loads(bundles.encode(rows, ["source"]).first()["record"])
    assert record["id"] == "a" and json.loads(record["component_data"]) == {"source": "s"}


def test_codecs_leave_broken_payloads_and_other_types(spark):
    rows = spark.createDataFrame([("T", "c", 1.0, '{"n": 4}'), ("T", "c", 1.0, "{no"), ("T", "c", 1.0, None), ("U", "c", 1.0, '{"n": 4}')], "type string, content string, score double, component_data string")
    codec = bundles.Codec("n int", lambda p: p.n.cast("string"), lambda p: p.n * 0.5)
    assert [(r["content"], r["score"]) for r in bundles.typed(rows, {"T": codec}).collect()] == [("4", 2.0), ("c", 1.0), ("c", 1.0), ("c", 1.0)]
    with pytest.raises(ValueError):
        bundles.typed(rows, {"": codec})
