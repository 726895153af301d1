"""Ids of a case in its candidates' features are found without a row that holds all ids."""

from pyspark.sql import functions as F

from ctxloom.operators import audit, select


def candidates(spark):
    made = [
        ("a", 1, "x-1", ["tag:x1"]),  # its own id
        ("a", 2, "X_22", ["tag:tox1n", None]),  # holds x1
        ("a", 3, "y", ["scope:local"]),
        ("b", 1, "x1", ["tag:tox2n"]),
        ("b", 2, "--", ["tag:gold"]),
        ("b", 3, None, ["tag:abc"]),
        ("b", 4, "q", []),
        ("b", 5, "ab", ["tag:abc", "tag:x9"]),
        (None, 1, "x9", ["tag:x9"]),
    ]
    rows = [(c, p, i, 0.5, {"learning_attributes": f} if f else {}) for c, p, i, f in made]
    return spark.createDataFrame(rows, "case_id string, pos int, item_id string, confidence double, metadata map<string, array<string>>")


def test_features_with_an_id_are_unsafe(spark):
    df = candidates(spark)
    ids = df.groupBy("case_id").agg(F.collect_set("item_id").alias("ids")).withColumnRenamed("case_id", "c")
    pairs = df.join(ids, df["case_id"].eqNullSafe(ids["c"]))
    expected = pairs.select("case_id", "pos", F.exists(F.coalesce(F.col("metadata")["learning_attributes"], F.array().cast("array<string>")), lambda f: audit.feature_reason(f, F.col("ids")).isNotNull()).alias("unsafe"))
    found = select.visible_features(df)
    assert {tuple(r) for r in found.select("case_id", "pos", "unsafe").collect()} == {tuple(r) for r in expected.collect()}
    assert found.where("unsafe").count() >= 4


def test_no_window_collects_a_case(spark):
    assert "collect_set" not in select.visible_features(candidates(spark))._jdf.queryExecution().optimizedPlan().toString()
