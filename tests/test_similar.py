"""Similarity self-joins: equal to all pairs, also where a term or a set is in very many rows."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ctxloom.operators import lexical
from ctxloom.plans import queries
from tests.test_queries import rows


def brute(rows, least):
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            share = len(x & y) / len(x | y) if x | y else 0
            if x and y and share >= least:
                out[min(a, b), max(a, b)] = round(share, 9)
    return out


@pytest.mark.parametrize("least", [0.4, 0.8, 1.0])
def test_equals_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    r = random.Random(5)
    rows = [(i, {f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(9))}) for i in range(150)]
    rows += [(i, {"same", "set", "of", "words"} | ({"more"} if i % 9 == 0 else set())) for i in range(150, 220)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in rows], "id long, terms array<string>")
    got = lexical.similar_pairs(df, least).collect()
    assert {(p["a"], p["b"]): round(p["similarity"], 9) for p in got} == brute(rows, least)
    assert len(got) == len({(p["a"], p["b"]) for p in got})


def test_odd_rows(spark):
    df = spark.createDataFrame([("b", ["x", "y"], 1), ("a", ["y", "x"], 2), ("c", [], 3), ("d", None, 4)], "name string, terms array<string>, key int")
    assert [tuple(p) for p in lexical.similar_pairs(df, 0.9, "name").collect()] == [("a", "b", 1.0)]
    assert lexical.similar_pairs(df.limit(0), 0.9, "name").count() == 0
    members, pairs = lexical.similar_sets(df, 0.9, "name")
    assert {tuple(m) for m in members.collect()} == {("a", "a"), ("b", "a")} and pairs.count() == 0


def test_a_key_of_all_rows_is_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, value in zip(before, ("32", "false", "-1"), strict=True):
            spark.conf.set(k, value)
        rows = spark.range(4000)
        left, right = rows.select(F.lit("hot").alias("k"), F.col("id").alias("x")), rows.select(F.lit("hot").alias("k"), F.col("id").alias("y"))
        parts = [r["count"] for r in lexical.block_join(left, right, "k", F.col("x") < F.col("y")).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert sum(parts) == 4000 * 3999 / 2 and len(parts) == 32 and max(parts) < sum(parts) / 8


def test_a_term_of_every_row(spark):
    rows = [(i, ["common", f"w{i // 2}", f"v{i}"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    assert {(p["a"], p["b"]) for p in lexical.similar_pairs(df, 0.5).collect()} == {(i, i + 1) for i in range(0, 3000, 2)}


def test_copies_are_members_and_not_pairs(spark):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(400)] + [(400 + i, ["a", "b", "c", "d", "e"]) for i in range(300)]
    found = lexical.with_members(*lexical.similar_sets(spark.createDataFrame(rows, "id long, terms array<string>"), 0.7)).collect()
    assert {(p["a"], p["b"], p["similarity"]) for p in found if not p["copy"]} == {(0, 400, 0.8)}
    assert {(p["a"], p["b"]) for p in found if p["copy"]} == {(0, i) for i in range(1, 400)} | {(400, i) for i in range(401, 700)}
    assert len(found) == 1 + 399 + 299


def test_only_claims_of_different_sense_meet(spark):
    said = ["water boils when heated", "water boils when heated", "Heated water boils not when", "water boils when cold", "bread rises", None, "not"]
    claims = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    members, pairs = lexical.contradictions(claims)
    assert {tuple(m) for m in members.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)}
    assert {(p["a"], p["b"], round(p["similarity"], 6)) for p in pairs.collect()} == {(0, 2, 1.0), (2, 3, 0.6)}


def folder_of(tmp_path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def in_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return con.execute(queries.ORACLES[name]).to_arrow_table()


def test_all_pairs_of_claims_and_their_copies(spark, tmp_path):
    texts = [*["the water boils when heated"] * 23, *["Water boils not when heated , the not so"] * 7, "bread rises", None, ""]
    folder = folder_of(tmp_path, texts)
    found = queries.QUERIES["j4_contradictions"](spark, folder).toArrow()
    assert rows(found) == rows(in_sql(folder, "j4_contradictions"))
    assert {(a, b) for a in range(23) for b in range(23, 30)} <= {(p["a"], p["b"]) for p in found.to_pylist()}


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
@pytest.mark.parametrize("most", [100, 4_000_000])
def test_opposed_rows_equal_all_pairs(spark, monkeypatch, least, most):
    monkeypatch.setattr(lexical, "TERMS_PER_PASS", most)
    r = random.Random(8)
    data = [(i, {f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(14))}, r.random() < 0.3) for i in range(260)]
    data += [(i, {"same", "set", "of", "words"} | ({"more"} if i % 9 == 0 else set()), i % 2 == 0) for i in range(260, 330)]
    df = spark.createDataFrame([(i, sorted(x), side) for i, x, side in data], "id long, terms array<string>, side boolean")
    sides = {i: side for i, _, side in data}
    got = lexical.opposed(df, least).collect()
    wanted = {k: x for k, x in brute([(i, x) for i, x, _ in data], least).items() if sides[k[0]] != sides[k[1]]}
    assert {(p["a"], p["b"]): round(p["similarity"], 9) for p in got} == wanted
    assert len(got) == len(wanted)


def test_opposed_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, ["a", "b", f"c{i % 3}"], i % 4 == 0) for i in range(200)], "id long, terms array<string>, side boolean")
    plan = lexical.opposed(df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert lexical.opposed(df.where("side"), 0.5).count() == 0 == lexical.opposed(df.limit(0), 0.5).count()


def test_all_pairs_of_documents_and_their_copies(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(40))
    texts = [*[long] * 21, *[f"{long} other"] * 6, *[long.upper()] * 3, "something else", "", None]
    folder = folder_of(tmp_path, texts)
    found = queries.QUERIES["j3_near_duplicates"](spark, folder).toArrow()
    assert rows(found) == rows(in_sql(folder, "j3_near_duplicates"))
    assert found.num_rows == 30 * 29 / 2


@pytest.mark.parametrize("keys", [0, 100_000])
def test_terms_of_few_buckets_and_many_blocks(spark, monkeypatch, keys):
    """Counts of buckets that many terms share, signatures that say little, pairs of classes of many blocks."""
    for name, value in {"BUCKETS": 4, "SIGNED": 64, "COMPARED": 16, "BLOCK": 8, "KEYS": keys}.items():
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(3)
    base = [{f"w{r.randrange(300)}" for _ in range(30)} for _ in range(12)]
    data = [(i, {w for w in base[i % 12] if r.random() < 0.95} | {f"v{r.randrange(40)}"}) for i in range(200)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in data], "id long, terms array<string>")
    got = lexical.similar_pairs(df, 0.8).collect()
    assert {(p["a"], p["b"]): round(p["similarity"], 9) for p in got} == brute(data, 0.8)


def test_sets_of_a_group_do_not_go_to_each_of_its_pairs(spark):
    """A pair of blocks reads each of its sets once, and pairs whose signatures differ much none."""
    rows_ = [(i, [f"w{k}" for k in range(60)] + [f"v{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows_, "id long, terms array<string>")
    _, pairs = lexical.similar_sets(df, 0.88)
    assert pairs.count() == 300 * 299 / 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "array_intersect" not in plan


@pytest.mark.parametrize("least", [0.5, 0.88])
def test_sets_of_very_different_lengths(spark, least):
    """Signatures of two lengths are compared by folding the longer one."""
    r = random.Random(4)
    data = [(i, {f"w{k}" for k in range(n) if r.random() < 0.97}) for i, n in enumerate(r.choice((1, 3, 120, 128, 133, 250, 260, 500, 515, 530, 1100)) for _ in range(90))]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in data], "id long, terms array<string>")
    got = lexical.similar_pairs(df, least).collect()
    assert {(p["a"], p["b"]): round(p["similarity"], 9) for p in got} == brute(data, least)
