"""Search by codes: equal to brute force where it is exact, near to it where it isn't."""

import numpy as np
import pytest

from ctxloom.operators import quantised
from ctxloom.plans import queries


def brute(spark, folder, n=10):
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in e]), np.array([r[1] for r in e], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in np.nonzero(ids % 50 == 0)[0]:
        s = np.round(v @ v[q], 9)
        out[int(ids[q])] = {int(ids[i]) for i in sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:n]}
    return out


def by_query(df):
    out = {}
    for r in df.select("query_id", "id").collect():
        out.setdefault(r["query_id"], set()).add(r["id"])
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    true = brute(spark, folder)
    assert by_query(queries.QUERIES["j14_quantised_exact"](spark, folder)) == true
    near = by_query(queries.QUERIES["j14_quantised_top"](spark, folder))
    assert sum(len(true[q] & near[q]) for q in true) >= 0.95 * sum(map(len, true.values()))


def test_codes_rule_rows_out(spark):
    v = queries._vectors(queries.Views(spark, "/root/testdata/sf0.1"))
    pairs = v[0].count() * v[1].count()
    assert quantised.candidates(*v, 10).count() < 0.25 * pairs
    assert quantised.candidates(*v, 10, parts=64).count() < 0.05 * pairs


def test_odd_vectors(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [-1.0, -1.0, -1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<float>, list string")
    asked = spark.createDataFrame([(0, rows[0][1]), (41, rows[41][1]), (99, [-1.0, 0.0, 0.0]), (100, None)], "query_id long, embedding array<float>")

    def similarity(a, b):
        norm = 0 if a is None or b is None else np.linalg.norm(np.float64(a)) * np.linalg.norm(np.float64(b))
        return round(float(np.dot(a, b) / norm), 9) if norm else 0.0

    out = quantised.quantised_top(asked, table, 5, parts=2, probes=2).collect()
    got = {q: [r["id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 41, 99, 100)}
    for q, vector in ((0, rows[0][1]), (41, rows[41][1]), (99, [-1.0, 0.0, 0.0]), (100, None)):
        assert got[q] == sorted((i for i, _ in rows if i != q), key=lambda i: (-similarity(vector, rows[i][1]), i))[:5]
    assert quantised.quantised_top(asked, table.limit(0), 5).count() == 0
    assert quantised.quantised_top(asked.limit(0), table, 5, parts=2).count() == 0
    assert quantised.quantised_top(asked, table.where("id = 40"), 5).count() == 4


def test_probes_leave_a_task_in_bounded_batches(spark, monkeypatch):
    pick = np.random.default_rng(1)
    rows = [(i, pick.normal(size=4).tolist(), -2.0) for i in range(20)]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<float>, least double")
    model = quantised.Model(pick.normal(size=(30, 4)).astype(np.float32), np.zeros((1, 1, 4), np.float32))
    whole = sorted(map(tuple, quantised._asked(asked, model, None, 7).collect()))
    assert len(whole) == 20 * 7
    monkeypatch.setattr(quantised, "ASKED", 3)
    assert sorted(map(tuple, quantised._asked(asked, model, None, 7).collect())) == whole
