"""Odd rows: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest

import corpus_pipeline
from ctxloom.llm import decontam, html_extract, jaccard_join, langid, lm, packing, quality, sharding, stages, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, word string, shard int, slot long, unit string, count long, band int, hash long, rank int"
REST = (None,) * 10
LONG = "very long words here and there " * 20000


def made(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t", "en", "a", 3), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)), (5, "one", "en", "a", 3), (5, "two", "fr", "b", 3), (None, "null id with some words in it", "de", "a", 9), (6, "½ ¾ 123 !!", "de", "a", 5), (7, "東京 は 大きい", "ja", "a", 5)]
    return spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(4, 0, 1), (4, 0, 0), (5, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "null id with some words in it"), (4, "one"), (None, "two")], "item_id long, text string")


OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d),
    "join": lambda s, d: jaccard_join.join(d),
    "identify": lambda s, d: langid.identify(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "quality": lambda s, d: quality.quality(d),
    "score": lambda s, d: lm.score(d),
    "shard": lambda s, d: sharding.shard(d.drop("shard", "slot"), "doc_id", 16),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, made(spark)).toPandas()
    assert len(out) == 10
    assert OPERATORS[name](spark, empty(spark)).count() == 0


def test_sharding_refuses_clashing_columns(spark):
    with pytest.raises(ValueError, match="shard"):
        sharding.shard(made(spark), "doc_id", 16)


def test_values_of_odd_rows(spark):
    n = token_counts.token_counts(made(spark)).toPandas().groupby("doc_id").n_tokens.first()
    assert n[1] == n[2] == 0 and n[4] > 100000
    links = jaccard_join.join(made(spark)).toPandas().set_index("doc_id")
    assert list(links.loc[4].n_copies) == [1, 1] and links.n_links.sum() == 0
    lang = langid.identify(made(spark)).toPandas().groupby("doc_id")[["lang_pred", "score"]].first()
    assert list(lang.lang_pred[[1, 2, 3, 6]]) == ["und"] * 4 and lang.lang_pred[7] != "und"
    q = quality.quality(made(spark)).toPandas().groupby("doc_id").first()
    assert not q.kept[[1, 2, 3, 4]].any() and q.longest_repeat[4] == 6 * 20000 - 6
    scores = lm.score(made(spark)).toPandas().groupby("doc_id").n_tokens.first()
    assert list(scores[[1, 2, 3]]) == [1, 1, 1]


def test_packing_of_odd_rows(spark):
    out = packing.pack(made(spark)).toPandas()
    assert out.length.sum() == out.groupby(["doc_id", "start", "sequence_id", "offset"], dropna=False).length.sum().sum()
    assert (out[out.doc_id.isin([1, 2])].doc_tokens == 1).all()
    assert packing.pack(empty(spark)).count() == 0


def test_decontamination_of_odd_rows(spark):
    out = decontam.matches(made(spark), items(spark)).toPandas()
    assert {3, 4} <= set(out.item_id.dropna())
    assert decontam.matches(empty(spark), items(spark)).count() == 0
    assert decontam.matches(made(spark), items(spark).limit(0)).count() == 0
    assert decontam.clean(made(spark), items(spark)).count() == 7


def test_pages_of_odd_rows(spark):
    schema = "page_id long, url string, html string, key string, lines string"
    rows = [(1, None, None), (2, "", ""), (3, "http://[bad", "<p>x"), (4, "http://a.b/", "<article><p>A<p>B</article><p>C"), (4, "http://a.b/", "<article><p>A<p>B</article><p>C"), (None, "http://a.b/c", "plain &lt; text <script>no")]
    out = html_extract.extract(spark.createDataFrame([(*r, "k", "l") for r in rows], schema)).toPandas()
    assert sorted(out.text) == sorted(["", "", "x", "A\nB\nC", "A\nB\nC", "plain < text"])
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("stage", [stages.quality_rules, stages.language_id, stages.jaccard_dedup])
def test_stages_keep_columns(spark, stage):
    for docs in (made(spark), empty(spark)):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        out.count()


def test_the_last_stages_of_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    for docs in (made(spark), empty(spark)):
        kept = stages.decontamination(spark, docs, folder)
        assert kept.columns == docs.columns and kept.count() == docs.count()
        assert {r["doc_id"] for r in stages.packed(spark, docs, folder).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_a_null_id_is_not_held_out(spark):
    for out in (langid.identify(made(spark)), toxicity.toxicity(made(spark), labels(spark))):
        assert {r["held_out"] for r in out.where("doc_id is null").collect()} == {False} and out.where("held_out is null").count() == 0


def test_pipeline_equals_its_parts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    kept = docs.where(docs.doc_id.isin(*left))
    score = langid.identify(kept).where(f"lang_pred <> 'und' and score >= {langid.MIN_SCORE}")
    kept = kept.where(docs.doc_id.isin(*[r["doc_id"] for r in score.collect()]))
    kept = kept.where(docs.doc_id.isin(*[r["doc_id"] for r in jaccard_join.join(kept).where("doc_id = class_id").collect()]))
    bad = {r["doc_id"] for r in decontam.matches(kept, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    expected = {r["doc_id"] for r in kept.collect()} - bad
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == expected


def test_dedup_keeps_one_row_of_each_class_whatever_its_id(spark):
    from collections import Counter

    many = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    near = many[0] + " end"
    rows = [(None, many[0]), (None, near), (None, many[1]), (None, many[2]), (None, many[2]), (7, many[3]), (7, many[4]), (8, many[3]), (9, many[5]), (9, near), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int")
    out = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()]
    assert Counter(out) == Counter([(9, near), (None, many[1]), (None, many[2]), (7, many[3]), (7, many[4]), (9, many[5]), (None, None), (None, "")])
