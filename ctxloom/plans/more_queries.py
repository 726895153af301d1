"""Queries of the research, experiment and composite operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import audit, consolidate, exact, filters, learn, lexical, rank, report, research, scoring, select, stats, vectors
from ..sources import bundles, tables
from . import pipelines, views
from .queries import METRICS, ORACLES, QUERIES, SQL_HOST, SQL_HYBRID, SQL_PAIRS, SQL_RANKED, SQL_RELEVANCE, SQL_REWARDS, SQL_TRAJECTORIES, SQL_UNITS, SQL_WEIGHT, _log, _rewards, _units, _vectors, long, packed, query, sql_class, sql_metrics, sql_sums, sql_terms, sql_words
from .views import AS_OF_S, Views, with_views

# research


@query()
def x13_html_to_text(v: Views) -> DataFrame:
    return research.html_to_text(v.table("pages")).select("page_id", "title", "text", "rejected")


SQL_SENTENCES = r"(SELECT doc_id, source, unnest(range(len(s))) AS pos, unnest(s) AS t FROM (SELECT doc_id, source, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS s FROM documents))"
SQL_DOC_CLAIMS = f"(SELECT doc_id, source, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {SQL_SENTENCES} WHERE length(t) BETWEEN 60 AND 500 AND substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND regexp_matches(t, '{text.CLAIM_VERBS}'))"
SQL_DOC_CLASS = "CASE doc_id % 4 WHEN 0 THEN 'primary_authority' WHEN 1 THEN 'strong_secondary' WHEN 2 THEN 'community_or_folklore' ELSE 'retail' END"
SQL_EVIDENCE = "CASE doc_id % 4 WHEN 0 THEN 'verified_fact' WHEN 1 THEN 'supported_interpretation' WHEN 2 THEN 'unverified_story' ELSE 'source_claim' END"


def _doc_sources(v: Views) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "primary_authority").when(F.col("doc_id") % 4 == 1, "strong_secondary").when(F.col("doc_id") % 4 == 2, "community_or_folklore").otherwise("retail")
    return v.table("documents").select(F.col("doc_id").alias("source_id"), "text", kind.alias("source_class"), F.col("lang").alias("project"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("read").alias("status"))


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, t AS text FROM {SQL_SENTENCES}")
def x14_sentences(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "text"))


@query(f"SELECT doc_id AS source_id, CAST(pos AS INT) AS pos, t AS text, {SQL_EVIDENCE} AS evidence_type, 0.55::DOUBLE AS confidence FROM {SQL_DOC_CLAIMS} WHERE n <= 12")
def w7_first_claims(v: Views) -> DataFrame:
    return research.claims(_doc_sources(v))


@query(f"SELECT doc_id AS source_id FROM documents WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM {SQL_DOC_CLAIMS})")
def j6_unprocessed_sources(v: Views) -> DataFrame:
    return research.unprocessed(_doc_sources(v), research.claims(_doc_sources(v)).select("source_id").distinct()).select("source_id")


@query("SELECT project, url, seq FROM (SELECT 'p' || (page_id % 3) AS project, split_part(url, '?', 1) AS url, page_id AS seq, row_number() OVER (PARTITION BY page_id % 3, split_part(url, '?', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1 AND seq % 4 > 0")
def j7_new_urls(v: Views) -> DataFrame:
    found = v.table("pages").select(F.concat(F.lit("p"), F.col("page_id") % 3).alias("project"), F.substring_index("url", "?", 1).alias("url"), F.col("page_id").alias("seq"))
    first = found.groupBy("project", "url").agg(F.min("seq").alias("seq")).where("seq % 4 = 0").select("project", "url")
    return research.new_urls(found, first)


@query(f"SELECT s.lang AS project, CAST(sources AS BIGINT) AS sources, CAST(claims AS BIGINT) AS claims FROM (SELECT lang, count(*) AS sources FROM documents GROUP BY 1) s LEFT JOIN (SELECT lang, count(*) AS claims FROM {SQL_DOC_CLAIMS} JOIN documents USING (doc_id) WHERE n <= 12 GROUP BY 1) c ON c.lang = s.lang")
def a17_research_status(v: Views) -> DataFrame:
    sources = _doc_sources(v)
    found = research.claims(sources).join(sources.select("source_id", "project"), "source_id")
    return research.status(sources, found).select("project", "sources", "claims")


@query(f"SELECT 1 AS section, doc_id * 1000 + pos AS seq, '- **' || {SQL_EVIDENCE} || '** (55%): ' || t || ' [S' || doc_id || ']' AS line FROM {SQL_DOC_CLAIMS} WHERE n <= 12 UNION ALL SELECT 2, doc_id, '- **[S' || doc_id || ']** [' || source || '](doc:' || doc_id || ') — ' || {SQL_DOC_CLASS} FROM documents")
def s14_claims_report(v: Views) -> DataFrame:
    found = research.claims(_doc_sources(v)).withColumn("claim_id", F.col("source_id") * 1000 + F.col("pos"))
    listed = v.table("documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url")).join(_doc_sources(v).select("source_id", "source_class"), "source_id")
    return research.report_lines(found, listed)


@query(r"SELECT page_id, contains(lower(url), 'tion') OR (contains(lower(html), 'tion') AND contains(lower(url), 'casino')) AS relevant FROM pages")
def f16_anchor_filter(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", research.relevant(F.col("url"), F.col("html"), F.lit(""), F.array(F.lit("tion")), F.array(F.lit("casino"))).alias("relevant"))


@query()
def p8_research_claims(v: Views) -> DataFrame:
    return pipelines.ingest(v.sql(views.PAGE_SOURCES), "exclude-community")[1]


@query(with_views(f"SELECT page_id, {sql_class(SQL_HOST)} AS source_class FROM page_sources WHERE page_id % 6 NOT IN (3, 4)", page_sources=views.PAGE_SOURCES))
def j5_sources_of_policy(v: Views) -> DataFrame:
    pages = v.sql(views.PAGE_SOURCES).withColumn("source_class", text.classify_source(F.col("url")))
    return pages.where(filters.source_policy("exclude-community", F.col("source_class")).isNull()).select("page_id", "source_class")


# filters and stores


@query(with_views("SELECT id, CAST(rank AS INT) AS rank, 1.0::DOUBLE AS score FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY seq) AS rank FROM memory WHERE 'en' IN (tag1, tag2, tag3)) WHERE rank <= 10", memory=views.MEMORY))
def f15_tag_search(v: Views) -> DataFrame:
    return filters.first_n(v.memory().where(F.array_contains("tags", "en")), 10, ["type"], ["seq"]).select("id", "rank", F.lit(1.0).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' || doc_id WHEN doc_id % 5 = 1 THEN text ELSE 'Recovered' END AS name FROM documents")
def s6_decode_payload(v: Views) -> DataFrame:
    key = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"name": "x'), key, F.lit('"}'))).when(F.col("doc_id") % 5 == 1, F.to_json(F.struct(F.col("text").alias("name")))).when(F.col("doc_id") % 5 == 2, "{broken")
    return v.table("documents").select("doc_id", tables.decode(raw, "name", F.lit("Recovered")).alias("name"))


@query("SELECT row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) + (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS sequence, CAST(o_orderkey AS VARCHAR) AS record_id, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS payload_hash FROM orders WHERE o_orderstatus = 'P'")
def s12_append_evidence(v: Views) -> DataFrame:
    old = _log(v).where("record_type = 'order_F'")
    new = _log(v).where("record_type = 'order_P'").select("record_type", "record_id", "payload_json")
    return tables.append_evidence(old, new).select("sequence", "record_id", "payload_hash")


@query("SELECT c_custkey AS case_id, list(n_name ORDER BY n_nationkey) AS names FROM (SELECT DISTINCT c_custkey, n.n_nationkey, n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey) GROUP BY 1")
def u1_ordered_distinct(v: Views) -> DataFrame:
    rows = v.table("customer").join(v.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("c_custkey").alias("case_id"), F.col("n_name").alias("name")).agg(F.min("n_nationkey").alias("pos"))
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


@query("SELECT o_custkey AS project, o_orderkey AS question FROM orders WHERE o_custkey % 3 > 0 UNION ALL SELECT DISTINCT o_custkey, -o_custkey FROM orders WHERE o_custkey % 3 = 0")
def u5_replace_questions(v: Views) -> DataFrame:
    old = v.table("orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("question"))
    new = old.where("project % 3 = 0").select("project", (-F.col("project")).alias("question")).distinct()
    return tables.replace(old, new, "project")


@query("SELECT coalesce(a.k, b.k) AS alias, CASE WHEN b.k IS NULL THEN 'not_annotated' WHEN a.k IS NULL THEN 'not_successful' ELSE 'criteria' END AS violation FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 7 > 0) a FULL JOIN (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderstatus)) AS c FROM orders WHERE o_custkey % 11 > 0 GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR c <> ['F', 'O', 'P']")
def u6_annotation_coverage(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderstatus").alias("criterion_id"))
    return audit.annotation_coverage(o.where("alias % 7 > 0").select("alias").distinct(), o.where("alias % 11 > 0"), ["F", "O", "P"])


@query("SELECT doc_id, doc_id % 50 = 0 OR doc_id % 40 = 0 AS leak FROM documents")
def x18_gold_leak(v: Views) -> DataFrame:
    gold = F.concat(F.lit("The  GOLD "), F.col("doc_id").cast("string"), F.lit("."))
    seen = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" the gold "), F.col("doc_id").cast("string"), F.lit(". "))).otherwise(F.col("text"))
    keys = F.when(F.col("doc_id") % 40 == 0, F.array(F.lit("Gold-Answer"))).otherwise(F.array(F.lit("format")))
    return v.table("documents").select("doc_id", audit.gold_leak(F.array(seen), gold, keys, ["goldanswer"]).alias("leak"))


@query("SELECT user_id AS cell_id, string_agg(k || '. [' || event_id || '] ' || event_type, chr(10) ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY 1")
def x21_numbered_evidence(v: Views) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    lines = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x.event_id.cast("string"), F.lit("] "), x.event_type))
    return v.table("events").groupBy(F.col("user_id").alias("cell_id")).agg(F.array_join(lines, "\n").alias("evidence"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([CASE WHEN l_discount > 0.08 THEN 'score_range' END, CASE WHEN l_quantity > 40 THEN 'over_budget' END, CASE WHEN l_tax = 0 THEN 'signal_missing' END], lambda x: x IS NOT NULL) AS violations FROM lineitem")
def x24_record_checks(v: Views) -> DataFrame:
    rules = {"score_range": F.col("l_discount") > 0.08, "over_budget": F.col("l_quantity") > 40, "signal_missing": F.col("l_tax") == 0}
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", audit.violations(rules).alias("violations"))


@query("SELECT o_orderkey, round(least(1.0, greatest(0.0, CAST(o_orderkey % 130 AS DOUBLE) / 100)), 6) AS progress, CASE WHEN o_orderkey % 130 >= 100 THEN 'completed' ELSE o_orderstatus END AS status FROM orders")
def m6_goal_progress(v: Views) -> DataFrame:
    p = scores.clamp(F.col("o_orderkey") % 130 / 100)
    return v.table("orders").select("o_orderkey", F.round(p, 6).alias("progress"), F.when(p >= 1, "completed").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"SELECT o_orderkey, round(({AS_OF_S} - epoch(o_orderdate)) / 60.0, 3)::DOUBLE AS age_minutes FROM orders")
def d1_ages(v: Views) -> DataFrame:
    at = F.try_to_timestamp(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return v.table("orders").select("o_orderkey", F.round((F.unix_micros(v.as_of) - F.unix_micros(at)) / 60e6, 3).alias("age_minutes"))


# consolidation and lineage


@query("SELECT 'd' || user_id AS new_id, CASE WHEN user_id % 4 = 1 THEN 'unknown_source' WHEN user_id % 4 = 2 THEN 'blank_content' ELSE 'id_exists' END AS violation FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 > 0")
def c1_derive_violations(v: Views) -> DataFrame:
    users = v.table("events").select("user_id").distinct()
    r = F.col("user_id") % 4
    commands = users.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("new_id"), F.when(r == 2, " ").otherwise("x").alias("content"), F.array(F.when(r == 1, "nowhere").otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string")))).alias("source_ids"), F.lit(True).alias("supersede"))
    memory = users.select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("id"), F.lit("c").alias("content")).union(users.where("user_id % 4 = 3").select(F.concat(F.lit("d"), F.col("user_id").cast("string")), F.lit("c")))
    return consolidate.derive(memory, commands)[1]


@query(with_views("SELECT id, CASE WHEN seq % 2 = 1 THEN 'superseded' ELSE status END AS status FROM memory", memory=views.MEMORY))
def c4_resolve(v: Views) -> DataFrame:
    none = F.array().cast("array<string>")
    m = v.memory().withColumn("supersedes_ids", none).withColumn("contradiction_ids", none)
    doc = lambda n: F.concat(F.lit("doc-"), n.cast("string"))
    pairs = m.where("seq % 2 = 1").select(doc(F.col("seq") - 1).alias("winner"), F.col("id").alias("loser"))
    return consolidate.resolve(m, pairs).select("id", "status")


@query("SELECT user_id AS id, CAST(k - 1 AS INT) AS pos, event_id AS source_id, event_type AS content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)")
def j11_lineage(v: Views) -> DataFrame:
    e = v.table("events")
    derived = e.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list("event_id")).alias("provenance_ids"))
    return consolidate.lineage(derived, e.select(F.col("event_id").alias("id"), F.col("event_type").alias("content")))


# vectors


@query()
def e1_embed(v: Views) -> DataFrame:
    return vectors.embed(v.table("documents").select("doc_id", "text"), "text").select("doc_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"), "error")


@query("SELECT count(*) AS rows, CAST(count_if(doc_id % 9 > 0) AS BIGINT) AS embedded, CAST(count_if(doc_id % 9 = 0) AS BIGINT) AS missing FROM documents")
def e4_embedding_status(v: Views) -> DataFrame:
    df = v.table("documents").withColumn("embedding", F.when(F.col("doc_id") % 9 > 0, F.array(F.lit(1.0))))
    return vectors.status(df)


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 32 ELSE 1 END AS INT) AS dimension FROM documents")
def e3_reembed_stale(v: Views) -> DataFrame:
    df = v.table("documents").select("doc_id", "text", F.array(F.lit(0.0).cast("float")).alias("embedding"), (F.col("doc_id") % 7 == 0).alias("stale"))
    return vectors.reembed(df, "text").select("doc_id", F.size("embedding").alias("dimension"))


@query(f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h2 DESC, id) AS INT) AS rank FROM (SELECT *, round(s * 0.8 + (id % 7) / 7.0 * 0.2, 9) AS h2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r FROM {SQL_PAIRS}) WHERE r <= 10)")
def t3_feedback_rerank(v: Views) -> DataFrame:
    queries, table = _vectors(v)
    cut = vectors.similar_top(queries, table.select("id", "embedding"), 10).drop("rank")
    again = cut.withColumn("h", F.round(F.col("similarity") * 0.8 + F.col("id") % 7 / 7.0 * 0.2, 9))
    return rank.rank(again, ["query_id"], "h", "id").select("query_id", "id", "rank")


@query(f"SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM {SQL_PAIRS} WHERE i = query_id % 10) WHERE rank <= 5")
def t4_similar_of_agent(v: Views) -> DataFrame:
    queries, table = _vectors(v)
    asked = queries.withColumn("agent", (F.col("query_id") % 10).cast("double").cast("string"))
    own = table.select("id", "embedding", F.col("score").cast("string").alias("agent"))
    return vectors.similar_top(asked, own, 5, on="agent").select("query_id", "id", "rank")


# experiments

SQL_ITEM = "(SELECT o_orderkey, CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'useful' WHEN 2 THEN 'misleading' ELSE 'irrelevant' END AS label, l_returnflag = 'R' AS selected, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _task_metrics(v: Views) -> DataFrame:
    r = (F.col("l_partkey") + F.col("l_suppkey")) % 4
    label = F.when(r == 0, "required").when(r == 1, "useful").when(r == 2, "misleading").otherwise("irrelevant")
    items = v.table("lineitem").join(v.table("orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", label.alias("label"), (F.col("l_returnflag") == "R").alias("selected"), F.col("l_quantity").cast("long").alias("tokens"))
    o = v.table("orders")
    key = F.col("o_orderkey")
    outcomes = o.select("o_orderkey", (key % 100 / 100.0).alias("quality"), (key % 10 > 0).alias("success"), (key % 7 > 0).alias("scored"), (key % 13 == 0).alias("critical"), (key % 17 == 0).alias("severe"), (key % 3).alias("corrections"), (key % 1000).alias("input_tokens"), (key % 100).alias("output_tokens"), (key % 50).cast("double").alias("latency_ms"), (key % 20).alias("selector_ms"), (key % 1000 / 1000.0).alias("cost"))
    return report.task_metrics(items, outcomes, ["o_orderkey"], 0.5)


SQL_TASKS = f"""WITH x AS (SELECT o_orderkey AS k, count_if(selected) AS n, sum(CASE WHEN selected THEN tokens ELSE 0 END) AS t, count_if(label = 'required') AS nr, count_if(label = 'useful') AS nu, count_if(selected AND label = 'required') AS sr, count_if(selected AND label = 'useful') AS su, count_if(selected AND label = 'misleading') AS sm, count_if(selected AND label = 'irrelevant') AS si FROM {SQL_ITEM} GROUP BY 1), tasks AS (
 SELECT k, unnest(['task_quality','execution_success','scored_outcome','critical_scoring_failure','severe_scoring_failure','correction_count','correction_required','selected_context_tokens','misleading_selected_count','irrelevant_selected_count','provider_input_tokens','provider_output_tokens','provider_latency_ms','selector_latency_ms','estimated_cost','pass','context_precision','context_recall','required_context_recall','misleading_selected_rate','irrelevant_selected_rate']) AS metric,
 unnest([q, CAST(k % 10 > 0 AS DOUBLE), CAST(k % 7 > 0 AS DOUBLE), CAST(k % 13 = 0 AS DOUBLE), CAST(k % 17 = 0 AS DOUBLE), k % 3, CAST(k % 3 > 0 AS DOUBLE), t, sm, si, k % 1000, k % 100, k % 50, k % 20, k % 1000 / 1000.0, CAST(k % 7 > 0 AND q >= 0.5 AND k % 13 > 0 AS DOUBLE), CASE WHEN n > 0 THEN (sr + su) / n END, CASE WHEN nr + nu > 0 THEN (sr + su) / (nr + nu) END, CASE WHEN nr > 0 THEN sr / nr END, CASE WHEN n > 0 THEN sm / n END, CASE WHEN n > 0 THEN si / n END]::DOUBLE[]) AS value
 FROM (SELECT *, CASE WHEN k % 10 > 0 AND k % 7 > 0 THEN (k % 100) / 100.0 ELSE 0 END AS q FROM x))"""


@query(f"{SQL_TASKS} SELECT k AS o_orderkey, metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'undefined_zero_denominator' END AS reason FROM tasks")
def a11_task_metrics(v: Views) -> DataFrame:
    return _task_metrics(v).withColumn("value", F.round("value", 6))


@query(f"{SQL_TASKS} SELECT metric, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS value FROM tasks GROUP BY 1")
def a12_strict_mean(v: Views) -> DataFrame:
    return _task_metrics(v).groupBy("metric").agg(F.round(report.strict_mean(), 6).alias("value"))


@query(with_views(f"SELECT 'a' AS arm_id, 1 AS repetition, family_id, CAST(sum(n) AS BIGINT) AS events, CAST(count_if(n >= 2) AS BIGINT) AS active, CAST(count_if(n < 2) AS BIGINT) AS inactive FROM (SELECT family_id, target, count(*) AS n FROM {SQL_REWARDS} GROUP BY 1, 2) GROUP BY 3", fb_items=views.FB_ITEMS))
def a16_evidence_summary(v: Views) -> DataFrame:
    states = learn.utilities(_rewards(v)).withColumn("arm_id", F.lit("a")).withColumn("repetition", F.lit(1))
    return report.evidence_summary(states)


@query("SELECT CAST(sum(CAST(strlen(text) + 1024 AS DECIMAL(18,0)) * CAST('0.2' AS DECIMAL(10,6)) + 2048 * CAST('1.25' AS DECIMAL(10,6))) AS DECIMAL(26,6)) AS micro_total, true AS within_cap FROM benchmark")
def a22_projected_cost(v: Views) -> DataFrame:
    return report.projected_cost(v.table("benchmark").select(F.col("text").alias("body"), F.lit(2048).alias("max_output_tokens")), "0.2", "1.25", "2.00")


@query("SELECT CAST(sum(v) AS BIGINT) AS valid, CAST(min(v) AS BIGINT) AS fewest, sum(v) >= 42 AND min(v) >= 4 AS execution_valid FROM (SELECT user_id, count_if(value > 10) AS v FROM events GROUP BY 1)")
def a23_validity_gate(v: Views) -> DataFrame:
    return stats.validity_gate(v.table("events").select(F.col("user_id").alias("cell_id"), (F.col("value") > 10).alias("valid")), 42, 4)


SQL_DRAWS = "(SELECT l_orderkey AS family, CASE l_linenumber % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'withheld' ELSE 'stale' END AS arm, l_discount * 10 AS score FROM lineitem)"
SQL_SIDES = ", ".join(f"{f}(score) FILTER (arm = '{arm}') AS {n}{arm[0]}" for arm in ("correct", "withheld", "stale") for f, n in (("sum", "s"), ("count", "n"), ("avg", "m")))
SQL_MATERIAL = "nc = 3 AND mc - mw >= 0.05 AND mc - ms >= 0.05 AND (sc - sw - (3 - nw)) / 3 >= 0.05 AND (sc - ss - (3 - ns)) / 3 >= 0.05"


@query(f"SELECT family, round(mc - mw, 6) AS observed_withheld, round(mc - ms, 6) AS observed_stale, round((sc - sw - (3 - nw)) / 3, 6) AS worst_withheld, round((sc - ss - (3 - ns)) / 3, 6) AS worst_stale FROM (SELECT family, {SQL_SIDES} FROM {SQL_DRAWS} GROUP BY 1)")
def n4_family_effects(v: Views) -> DataFrame:
    x = _families(v)
    return x.select("family", *[F.round(c, 6).alias(c) for c in x.columns[1:5]])


def _families(v: Views) -> DataFrame:
    r = F.col("l_linenumber") % 3
    draws = v.table("lineitem").select(F.col("l_orderkey").alias("family"), F.when(r == 0, "correct").when(r == 1, "withheld").otherwise("stale").alias("arm"), (F.col("l_discount") * 10).alias("score"))
    return stats.family_effects(draws, 3, 0.05)


@query(f"SELECT CAST(count_if(p) AS BIGINT) AS passing, bool_or(family = -1) AS safety_stop, CASE WHEN count_if(p) >= 2 THEN 'continue' WHEN count_if(p) = 1 THEN 'narrow' ELSE 'stop_or_redesign_once' END AS verdict FROM (SELECT family, {SQL_MATERIAL.replace('>= 0.05', '>= 0.05 - 1e-9')} AS p FROM (SELECT family, {SQL_SIDES} FROM {SQL_DRAWS} GROUP BY 1))")
def a24_verdict(v: Views) -> DataFrame:
    return stats.verdict(_families(v).select(F.col("material_pass").alias("passes"), (F.col("family") == -1).alias("critical")))


@query("SELECT l_orderkey AS unit_id, round(CASE WHEN bool_or(l_returnflag = 'A' AND l_quantity > 45) THEN least(sum(w * s), 0.2) ELSE sum(w * s) END, 6) AS score, bool_or(l_returnflag = 'A' AND l_quantity > 45) AS critical FROM (SELECT *, 1.0 / (1 + l_linenumber) AS w, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0 END AS s FROM lineitem) GROUP BY 1")
def a10_annotation_scores(v: Views) -> DataFrame:
    li = v.table("lineitem")
    status = F.when(F.col("l_returnflag") == "N", "met").when(F.col("l_returnflag") == "R", "partial").otherwise("not_met")
    marks = li.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("criterion_id"), status.alias("status"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).alias("critical"))
    weights = marks.select("criterion_id").distinct().withColumn("weight", 1.0 / (1 + F.col("criterion_id")))
    return scoring.annotations(marks, weights).withColumn("score", F.round("score", 6))


@query("SELECT o_custkey AS agent_id, count(*) AS total_goals, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS active_goals, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS completed_goals, CAST(count_if(o_orderdate < TIMESTAMP '1995-01-01') AS BIGINT) AS overdue_goals FROM orders GROUP BY 1")
def a3_agent_stats(v: Views) -> DataFrame:
    goals = v.table("orders").select(F.col("o_custkey").alias("agent_id"), F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), F.col("o_orderdate").cast("string").alias("deadline"))
    return audit.agent_stats(goals, F.lit("1995-01-01").cast("timestamp"))


@query("SELECT 'order_' || o_orderstatus AS record_type, count(*) AS n, CAST(count_if(o_orderkey % 89 = 0 OR o_orderkey % 97 = 0) AS BIGINT) AS violations FROM orders GROUP BY 1")
def a20_integrity_report(v: Views) -> DataFrame:
    why = audit.record_reason(F.col("payload_json"), F.col("payload_hash"), F.col("inserted"), F.col("schema_version"))
    return audit.integrity_report(_log(v).withColumn("reason", why))


@query("SELECT a.l_linenumber AS repetition, a.f AS left_arm, b.f AS right_arm, list_filter([CASE WHEN a.q <> b.q THEN 'quantity' END, CASE WHEN a.d <> b.d THEN 'discount' END], lambda x: x IS NOT NULL) AS differing, a.q = b.q AND a.d = b.d AS valid FROM (SELECT l_linenumber, l_returnflag AS f, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_linenumber, l_returnflag AS f, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) b ON a.l_linenumber = b.l_linenumber AND a.f < b.f")
def j12_comparability(v: Views) -> DataFrame:
    m = v.table("lineitem").groupBy(F.col("l_linenumber").alias("repetition"), F.col("l_returnflag").alias("arm_id")).agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    return audit.comparable(m, ["quantity", "discount"])


@query("SELECT substr(sha256('s1|alias|' || o_orderkey), 1, 32) AS alias, o_orderkey AS unit_id FROM orders WHERE o_orderkey % 2 = 0")
def j10_alias_resolution(v: Views) -> DataFrame:
    units = audit.aliases(v.table("orders").select((F.col("o_orderkey") % 5).alias("draw"), F.col("o_orderkey").alias("unit_id")), "s1")
    marks = units.where("unit_id % 2 = 0").select("alias")
    return audit.resolve_aliases(marks, units)[0].select("alias", "unit_id")


@query("SELECT substr(sha256('s1|alias|' || o_orderkey), 1, 32) AS alias, o_orderpriority AS answer FROM orders WHERE o_orderstatus = 'F'")
def j17_blind_export(v: Views) -> DataFrame:
    o = v.table("orders")
    units = audit.aliases(o.select((F.col("o_orderkey") % 5).alias("draw"), F.col("o_orderkey").alias("unit_id")), "s1")
    outcomes = o.select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("state"), F.col("o_orderpriority").alias("answer"), F.lit("x").alias("condition"))
    return audit.blind_export(outcomes, units, ["answer"]).select("alias", "answer")


@query("SELECT n_nationkey || '-' || r AS unit_id FROM nation, (SELECT unnest(range(5)) AS r)")
def j18_design(v: Views) -> DataFrame:
    return audit.design(v.table("nation").select(F.col("n_nationkey").alias("cell")), 5).select("unit_id")


# selection


def sql_fold(live: str) -> str:
    """The fold of budget packing over `live` (query_id, id, rank, k, tokens, token_budget)."""
    fits = "l.tokens <= l.token_budget - f.used"
    return f"""fold AS (SELECT query_id, id, rank, k, tokens, CASE WHEN tokens <= token_budget THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= token_budget THEN 'included' ELSE 'over_budget' END AS reason FROM {live} WHERE k = 1
  UNION ALL SELECT l.query_id, l.id, l.rank, l.k, l.tokens, f.used + CASE WHEN {fits} THEN l.tokens ELSE 0 END, CASE WHEN {fits} THEN 'included' WHEN f.used >= l.token_budget THEN 'budget_exhausted' ELSE 'over_budget' END FROM fold f JOIN {live} l ON l.query_id = f.query_id AND l.k = f.k + 1)"""


def sql_pack(live: str, rest: str) -> str:
    """The fold, and rows that it never sees."""
    return f"{sql_fold(live)} SELECT query_id, id, CAST(rank AS INT) AS rank, reason = 'included' AS included, reason, CAST(tokens AS INT) AS tokens FROM fold UNION ALL {rest}"


#: Every document is a candidate of one case.
SQL_CASES = "(SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark)"


def _bundle(v: Views) -> tuple[DataFrame, DataFrame]:
    d = v.table("documents")
    cases = v.table("benchmark").select(F.col("item_id").alias("case_id"), F.col("item_id").alias("ordinal"), F.concat(F.lit("f"), F.col("item_id") % 4).alias("family_id"), F.col("text").alias("prompt"), F.lit(400).alias("token_budget"))
    item = F.concat(F.lit("x"), F.col("doc_id").cast("string"))
    scope = F.when(F.col("doc_id") % 3 == 0, "scope:bounded").when(F.col("doc_id") % 3 == 1, "scope:global").otherwise("scope:local")
    shape = F.when(F.col("n_chars") > 1000, "format:runbook").otherwise("format:note")
    made = d.select(item.alias("item_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), text.token_count(F.col("text")).alias("token_count"), (F.col("doc_id") % 10 / 10).alias("confidence"), F.create_map(F.lit("format"), F.array(shape), F.lit("learning_attributes"), F.array(F.when(F.col("doc_id") % 31 == 0, "tag:gold").otherwise(scope))).alias("metadata"), (F.col("doc_id") % v.table("benchmark").count()).alias("_k"))
    places = cases.select("case_id", (F.row_number().over(Window.orderBy("case_id")) - 1).cast("long").alias("_k"))
    return cases, made.join(places, "_k").drop("_k")


SQL_BUNDLE = f"(SELECT *, CASE WHEN len(q) = 0 OR len(m) = 0 THEN 0 ELSE least(1.0, len(list_intersect(q, m)) / sqrt(len(q) * len(m)) + CASE WHEN contains(lower(text), lower(prompt)) THEN 0.15 ELSE 0 END) END AS relevance FROM (SELECT b.item_id AS query_id, 'x' || d.doc_id AS id, d.doc_id AS pos, d.text, b.text AS prompt, len({sql_words('d.text')}) AS tokens, 400 AS token_budget, {sql_terms('b.text')} AS q, {sql_terms('d.text')} AS m FROM {SQL_CASES} b JOIN documents d ON d.doc_id % b.n = b.k))"


def sql_decisions(ranked: str, rest: str) -> str:
    """Decisions of ranked rows (with k), in the columns of a selection."""
    body = sql_pack("live", rest)
    return f"WITH RECURSIVE live AS MATERIALIZED ({ranked}), {body.replace(' SELECT query_id, id, CAST(rank AS INT) AS rank, reason', ' SELECT query_id AS case_id, id AS item_id, reason')}"


@query(sql_decisions(f"SELECT *, rank AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, pos) AS rank FROM {SQL_BUNDLE}) WHERE rank <= 5", f"SELECT query_id, id, false, 'max_components', CAST(tokens AS INT) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, pos) AS rank FROM {SQL_BUNDLE}) WHERE rank > 5"))
def p5_similarity_top_k(v: Views) -> DataFrame:
    return select.select(*_bundle(v), "similarity_top_k")


SQL_STATIC = f"(SELECT *, CASE WHEN most = 1 THEN 0.5 ELSE (d - 1) / (most - 1) END AS importance FROM (SELECT *, max(d) OVER (PARTITION BY query_id) AS most FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY (pos % 10) / 10 + CASE WHEN pos % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END) AS d FROM {SQL_BUNDLE} WHERE pos % 31 > 0)))"


@query(sql_decisions(f"SELECT *, rank AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round((relevance * 0.7 + importance * 0.3) / 1.0, 12) DESC, pos) AS rank FROM {SQL_STATIC})", f"SELECT query_id, id, false, 'processing_error', CAST(tokens AS INT) FROM {SQL_BUNDLE} WHERE pos % 31 = 0"))
def p5_static_policy(v: Views) -> DataFrame:
    return select.select(*_bundle(v), "static_policy", weights={"confidence": 1.0, "scope:bounded": 0.5})


@query(f"""WITH RECURSIVE c AS (SELECT b.item_id AS case_id, 'x' || d.doc_id AS item_id, len({sql_words('d.text')}) AS t, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS k FROM {SQL_CASES} b JOIN documents d ON d.doc_id % b.n = b.k),
 f AS (SELECT case_id, item_id, k, t, CASE WHEN t <= 400 THEN t ELSE 0 END AS used, CASE WHEN t <= 400 THEN 'included' ELSE 'over_budget' END AS reason FROM c WHERE k = 1
 UNION ALL SELECT c.case_id, c.item_id, c.k, c.t, f.used + CASE WHEN c.t <= 400 - f.used THEN c.t ELSE 0 END, CASE WHEN c.t <= 400 - f.used THEN 'included' WHEN f.used >= 400 THEN 'budget_exhausted' ELSE 'over_budget' END FROM f JOIN c ON c.case_id = f.case_id AND c.k = f.k + 1)
 SELECT case_id, item_id, reason = 'included' AS included, reason, CAST(t AS INT) AS tokens FROM f""")
def p5_full_context(v: Views) -> DataFrame:
    return select.select(*_bundle(v), "full_context")


SQL_KNOWN = """(SELECT b.item_id AS query_id, target, sum(reward) / (2 + count(*)) AS u FROM benchmark b JOIN (SELECT 'f' || (ordinal % 4) AS family_id, case_id, ordinal, target, avg(reward) AS reward FROM (SELECT case_id, ordinal, f1 AS target, reward FROM fb UNION ALL SELECT case_id, ordinal, f2, reward FROM fb) WHERE reward IS NOT NULL GROUP BY 1, 2, 3, 4) r ON r.family_id = 'f' || (b.item_id % 4) AND r.ordinal < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2)"""
SQL_FEATURES = "[CASE WHEN length(text) > 1000 THEN 'format:runbook' ELSE 'format:note' END, CASE pos % 3 WHEN 0 THEN 'scope:bounded' WHEN 1 THEN 'scope:global' ELSE 'scope:local' END]"
SQL_RAW = f"(SELECT p.*, round((p.pos % 10) / 10 + coalesce(l.u, 0), 12) AS raw FROM {SQL_BUNDLE} p LEFT JOIN (SELECT query_id, id, sum(u) AS u FROM (SELECT query_id, id, unnest({SQL_FEATURES}) AS target FROM {SQL_BUNDLE}) x JOIN {SQL_KNOWN} USING (query_id, target) GROUP BY 1, 2) l USING (query_id, id) WHERE pos % 31 > 0)"
SQL_ADAPTIVE = f"(SELECT *, CASE WHEN most = 1 THEN 0.5 ELSE (d - 1) / (most - 1) END AS importance FROM (SELECT *, max(d) OVER (PARTITION BY query_id) AS most FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY raw) AS d FROM {SQL_RAW})))"
SQL_ARMS = {
    "full_context": ORACLES["p5_full_context"],
    "similarity_top_k": ORACLES["p5_similarity_top_k"],
    "static_policy": ORACLES["p5_static_policy"],
    "adaptive_policy": sql_decisions(f"SELECT *, rank AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round((relevance * 0.7 + importance * 0.3) / 1.0, 12) DESC, pos) AS rank FROM {SQL_ADAPTIVE})", f"SELECT query_id, id, false, 'processing_error', CAST(tokens AS INT) FROM {SQL_BUNDLE} WHERE pos % 31 = 0").replace("WITH RECURSIVE ", f"WITH RECURSIVE fb AS ({views.duck(views.FB_ITEMS)}), "),
}


def _experiment(v: Views) -> tuple[DataFrame, DataFrame]:
    items = v.sql(views.FB_ITEMS).withColumn("features", F.array("f1", "f2")).withColumn("family_id", F.concat(F.lit("f"), (F.col("ordinal") % 4).cast("string")))
    return pipelines.experiment(*_bundle(v), learn.event_rewards(items, "features"), {"confidence": 1.0, "scope:bounded": 0.5}, 2)


@query(SQL_ARMS["adaptive_policy"])
def p6_adaptive_policy(v: Views) -> DataFrame:
    items = v.sql(views.FB_ITEMS).withColumn("features", F.array("f1", "f2")).withColumn("family_id", F.concat(F.lit("f"), (F.col("ordinal") % 4).cast("string")))
    cases, candidates = _bundle(v)
    known = select.prefix_utilities(cases, learn.event_rewards(items, "features"))
    return select.select(cases, candidates, "adaptive_policy", weights={"confidence": 1.0}, utilities=known)


@query(" UNION ALL ".join(f"SELECT '{arm}' AS arm_id, CAST(r AS INT) AS repetition, x.* FROM ({SQL_ARMS[arm]}) x, (VALUES (1), (2)) AS t(r)" for arm in ("full_context", "similarity_top_k", "static_policy")))
def p6_experiment(v: Views) -> DataFrame:
    """The arms without learning; p6_adaptive_policy holds the fourth against SQL."""
    return _experiment(v)[0].where("arm_id <> 'adaptive_policy'")


@query("SELECT item_id AS case_id, 'x' AS rule FROM benchmark WHERE false")
def p6_fairness(v: Views) -> DataFrame:
    return _experiment(v)[1]


# composites


SQL_IMPORTANCE = f"(SELECT m.*, m.score + 0.7 * coalesce(a.average, 0) + 0.3 * coalesce(t.average, 0) AS importance FROM memory m LEFT JOIN (SELECT component_id AS id, sum(score * {SQL_WEIGHT}) / sum({SQL_WEIGHT}) AS average FROM feedback GROUP BY 1) a ON a.id = m.id LEFT JOIN (SELECT component_type AS type, sum(score * {SQL_WEIGHT}) / sum({SQL_WEIGHT}) AS average FROM feedback GROUP BY 1) t ON t.type = m.type)"


def sql_ranked(filter_: str = "", least: float = 0, requests: str = views.REQUESTS, required: str = "false") -> str:
    """CTEs up to `ranked` (all eligible rows) and `live` (those that reach the fold); filter_: WHEN clauses after the lifecycle's."""
    return f"""WITH RECURSIVE memory AS ({views.duck(views.MEMORY)}), requests AS ({views.duck(requests)}), feedback AS ({views.duck(views.FEEDBACK)}),
 cand AS MATERIALIZED (SELECT r.*, m.id, m.seq, m.importance, m.content, CASE WHEN m.type IN ('LongTermMemoryComponent', 'AgentSessionComponent') THEN pow(0.5, ({AS_OF_S} - m.ts_s) / 86400.0 / 30) ELSE 0 END AS recency,
  CASE WHEN expires_s <= {AS_OF_S} THEN 'lifecycle_expired' WHEN status <> 'active' THEN 'lifecycle_' || status {filter_} ELSE 'eligible' END AS reason FROM requests r, {SQL_IMPORTANCE} m),
 near AS MATERIALIZED (SELECT query_id, id, relevance FROM {SQL_RELEVANCE}),
 ranked AS MATERIALIZED (SELECT *, CASE WHEN {required} THEN 'required_term_miss' WHEN relevance < {least} THEN 'below_relevance_threshold' END AS early, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, seq) AS rank FROM (SELECT c.*, {sql_terms('c.content')} AS terms, coalesce(n.relevance, 0) AS relevance, len({sql_words('c.content')}) AS tokens, round(0.70 * coalesce(n.relevance, 0) + 0.25 * least(1.0, greatest(0.0, importance)) + 0.05 * recency, 12) AS total FROM cand c LEFT JOIN near n ON n.query_id = c.query_id AND n.id = c.id WHERE reason = 'eligible')),
 live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ranked WHERE early IS NULL)"""


SQL_LEFT_OUT = "SELECT query_id, id, CAST(rank AS INT), false, early, CAST(tokens AS INT) FROM ranked WHERE early IS NOT NULL UNION ALL SELECT query_id, id, NULL, false, reason, NULL FROM cand WHERE reason <> 'eligible'"


@query(f"""{sql_ranked("WHEN tag3 <> 'long' THEN 'tag_filter'", 0.05)}, {sql_pack('live', SQL_LEFT_OUT)}""")
def p1_retrieve(v: Views) -> DataFrame:
    asked = v.requests().withColumn("include_tags", F.array(F.lit("long"))).withColumn("min_relevance", F.lit(0.05))
    return pipelines.retrieve(v.memory(), asked, v.feedback(), v.as_of).drop("summary")


@query(f"{sql_ranked()}, {sql_fold('live')} SELECT f.query_id, string_agg(m.content, chr(10) || chr(10) ORDER BY f.rank) AS context, CAST(sum(f.tokens) AS BIGINT) AS used_tokens FROM fold f JOIN memory m ON m.id = f.id WHERE f.reason = 'included' GROUP BY 1")
def p1_context(v: Views) -> DataFrame:
    found = pipelines.retrieve(v.memory(), v.requests(), v.feedback(), v.as_of, rejected=False, only_included=True)
    return pipelines.context(found, v.memory())


SQL_SHORT = f"list_slice({sql_words('substr(l.content, 1, CAST(4 * room AS BIGINT))')}, 1, room)"


@query(f"""{sql_ranked("WHEN tag3 <> 'short' THEN 'tag_filter'")},
 fold AS (SELECT query_id, id, rank, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS used, '' AS reason FROM live WHERE k = 1
  UNION ALL SELECT query_id, id, rank, k, tokens, used + CASE WHEN starts_with(reason, 'included') THEN tokens ELSE 0 END, reason FROM (SELECT query_id, id, rank, k, used, CASE WHEN own <= room OR room <= 0 THEN own ELSE len(short) END AS tokens, CASE WHEN own <= room THEN 'included' WHEN room <= 0 THEN 'budget_exhausted' WHEN len(short) = 0 THEN 'summarization_failed_budget' ELSE 'included_summarized' END AS reason
   FROM (SELECT l.query_id, l.id, l.rank, l.k, l.used, l.tokens AS own, l.room, {SQL_SHORT} AS short FROM (SELECT l.*, f.used, 700 - f.used AS room FROM fold f JOIN live l ON l.query_id = f.query_id AND l.k = f.k + 1) l)))
 SELECT query_id, id, CAST(rank AS INT) AS rank, starts_with(reason, 'included') AS included, reason, CAST(tokens AS INT) AS tokens FROM fold WHERE k > 0 UNION ALL {SQL_LEFT_OUT}""")
def p2_task_context(v: Views) -> DataFrame:
    tasks = v.requests().withColumn("include_tags", F.array(F.lit("short")))
    return pipelines.task_context(v.memory(), tasks, v.feedback(), v.as_of).drop("summary")


SQL_FOUND = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({SQL_HYBRID}, 9) DESC, id) AS place FROM (SELECT p.query_id, p.id, p.s, p.i, p.g, 0.0 AS f, d.text FROM {SQL_PAIRS} p JOIN documents d ON d.doc_id = p.id))"


@query(with_views(f"""SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(CASE WHEN total <= 500 THEN tokens ELSE 500 - total + tokens END AS BIGINT) AS taken FROM (SELECT *, sum(CASE WHEN total > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS misses FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total
 FROM (SELECT query_id, id, len({sql_words('text')}) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY round({SQL_HYBRID}, 9) DESC, id) AS rank FROM (SELECT p.query_id, p.id, p.s, p.i, p.g, p.text, coalesce(a.average, 0) AS f FROM {SQL_FOUND} p LEFT JOIN (SELECT CAST(substr(component_id, 5) AS BIGINT) AS id, sum(score * {SQL_WEIGHT}) / sum({SQL_WEIGHT}) AS average FROM feedback GROUP BY 1) a ON a.id = p.id WHERE place <= 10)))) WHERE misses = 0 OR (misses = 1 AND total > 500 AND 500 - total + tokens > 50)""", feedback=views.FEEDBACK))
def p3_semantic_context(v: Views) -> DataFrame:
    queries, table = _vectors(v)
    content = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return pipelines.semantic_context(queries.withColumn("token_budget", F.lit(500)), table.drop("feedback_score").join(content, "id"), v.feedback().withColumn("component_id", F.substring_index("component_id", "-", -1).cast("long")), v.as_of)


SQL_FIRST_WORDS = "array_to_string(list_slice(string_split(query, ' '), 1, 3), ' ')"
SQL_MISSED = f"NOT list_has_any(terms, {sql_terms(SQL_FIRST_WORDS)})"
SQL_ALIKE = "len(list_filter(f.sets, lambda s: len(list_intersect(s, l.terms)) > 0 AND len(list_intersect(s, l.terms)) >= 0.88 * len(list_distinct(list_concat(s, l.terms))) - 1e-12)) > 0"


@query(f"""{sql_ranked("WHEN tag1 <> 'en' THEN 'tag_filter'", 0.1, required=SQL_MISSED)},
 fold AS (SELECT query_id, id, rank, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS chosen, CAST([] AS VARCHAR[][]) AS sets, '' AS reason FROM live WHERE k = 1
  UNION ALL SELECT query_id, id, rank, k, tokens, used + CASE WHEN reason = 'included' THEN tokens ELSE 0 END, chosen + CASE WHEN reason = 'included' THEN 1 ELSE 0 END, CASE WHEN reason = 'included' THEN list_append(sets, terms) ELSE sets END, reason
   FROM (SELECT l.query_id, l.id, l.rank, l.k, l.tokens, l.terms, f.used, f.chosen, f.sets, CASE WHEN {SQL_ALIKE} THEN 'redundant' WHEN f.chosen >= 20 THEN 'max_components' WHEN l.tokens <= l.token_budget - f.used THEN 'included' WHEN f.used >= l.token_budget THEN 'budget_exhausted' ELSE 'over_budget' END AS reason FROM fold f JOIN live l ON l.query_id = f.query_id AND l.k = f.k + 1))
 SELECT query_id, id, CAST(rank AS INT) AS rank, reason = 'included' AS included, reason, CAST(tokens AS INT) AS tokens FROM fold WHERE k > 0 UNION ALL {SQL_LEFT_OUT}""")
def p9_memory_trace(v: Views) -> DataFrame:
    asked = v.requests().withColumn("include_tags", F.array(F.lit("en"))).withColumn("required_terms", F.array(F.substring_index("query", " ", 3)))
    return pipelines.memory_trace(v.memory(), asked, v.feedback(), v.as_of).drop("summary")


SECTIONS = {"goals": ("en", "long"), "tasks": ("en", "short"), "learnings": ("fr",)}
SQL_SECTIONS = "SELECT item_id || '/' || section AS query_id, item_id, section, wanted, text AS query, CAST(floor((200 + 50 * (item_id % 5)) / 3) AS INT) AS token_budget FROM {benchmark}, (VALUES " + ", ".join(f"('{name}', {list(tags)})" for name, tags in SECTIONS.items()) + ") AS s(section, wanted)"


@query(f"{sql_ranked('WHEN NOT list_has_all([tag1, tag2, tag3], wanted) THEN ' + repr('tag_filter'), requests=SQL_SECTIONS)}, {sql_fold('live')} SELECT l.item_id AS query_id, l.section, f.id, CAST(f.rank AS INT) AS rank, CAST(f.tokens AS INT) AS tokens FROM fold f JOIN live l ON l.query_id = f.query_id AND l.id = f.id WHERE f.reason = 'included'")
def w6_agent_sections(v: Views) -> DataFrame:
    return pipelines.agent_context(v.memory(), v.requests(), v.feedback(), v.as_of, SECTIONS).where("included").select("query_id", "section", "id", "rank", "tokens")


@query(with_views(f"SELECT phase, metric, round(avg(effect), 5) AS mean_effect, count(*) AS repetitions FROM {SQL_TRAJECTORIES} GROUP BY 1, 2", task_metrics=views.TASK_METRICS))
def p7_paired_report(v: Views) -> DataFrame:
    longer = report.long_form(v.sql(views.TASK_METRICS), ["task_quality", "selected_context_tokens"])
    return report.summaries(report.trajectories(report.paired_effects(longer, "static_policy", "adaptive_policy"))).select("phase", "metric", F.round("mean_effect", 5).alias("mean_effect"), "repetitions")


SQL_CHOSEN = "(SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, tokens FROM fold WHERE reason = 'included')"


@query(f"""WITH RECURSIVE memory AS ({views.duck(views.MEMORY)}), requests AS ({views.duck(views.REQUESTS)}), eval_labels AS ({views.duck(views.EVAL_LABELS)}),
 live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM (SELECT query_id, id, rank, relevance, token_budget, len({sql_words('content')}) AS tokens FROM {SQL_RANKED}) WHERE relevance >= 0.05), {sql_fold('live')}
 SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)}, 1.0::DOUBLE AS stability FROM ({sql_metrics(SQL_CHOSEN)})""")
def p4_evaluate(v: Views) -> DataFrame:
    requests = v.requests()
    excluded = requests.select("query_id", (F.col("query_id") % 97).alias("k")).join(v.memory().select("id", (F.col("seq") % 97).alias("k")), "k").drop("k")
    m = pipelines.evaluate_retrieval(packed(v, only_included=True), v.eval_labels(), excluded, requests)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


SQL_LABEL = "CASE pos % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'useful' WHEN 2 THEN 'misleading' ELSE 'irrelevant' END"
SQL_ATTRIBUTE = "CASE WHEN pos % 31 = 0 THEN 'tag:gold' WHEN pos % 3 = 0 THEN 'scope:bounded' WHEN pos % 3 = 1 THEN 'scope:global' ELSE 'scope:local' END"
SQL_REGEX_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*')"
SQL_SECRET = " OR ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in text.SECRET_PATTERNS)
SQL_HASH = r"sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')))"


@query(f"""WITH c AS MATERIALIZED (SELECT query_id AS case_id, id AS item_id, pos, text, tokens, {SQL_LABEL} AS label, {SQL_ATTRIBUTE} AS attribute, pos % 23 > 0 AS labelled, source FROM (SELECT x.*, d.source FROM {SQL_BUNDLE} x JOIN documents d ON d.doc_id = x.pos))
 SELECT case_id, item_id, 'unlabelled' AS rule FROM c WHERE NOT labelled
 UNION ALL SELECT case_id, item_id, 'token_count' FROM c WHERE len({SQL_REGEX_TOKENS}) <> tokens
 UNION ALL SELECT case_id, item_id, 'secret' FROM c WHERE {SQL_SECRET}
 UNION ALL SELECT case_id, item_id, 'split_leakage' FROM c WHERE {SQL_HASH} IN (SELECT {SQL_HASH} FROM c GROUP BY 1 HAVING count(DISTINCT case_id % 2) > 1)
 UNION ALL SELECT case_id, item_id, 'gold_leak' FROM c WHERE case_id % 3 = 0 AND pos % 37 = 0
 UNION ALL SELECT NULL, attribute, 'shortcut_attribute' FROM c WHERE labelled GROUP BY 2 HAVING count(*) > 1 AND count(DISTINCT label) = 1
 UNION ALL SELECT NULL, source, 'shortcut_source' FROM c WHERE labelled GROUP BY 2 HAVING count(*) > 1 AND count(DISTINCT label) = 1
 UNION ALL SELECT case_id, attribute, 'ambiguous_attribute' FROM c WHERE labelled GROUP BY 1, 2 HAVING count_if(label IN ('required', 'useful')) > 0 AND count_if(label = 'misleading') > 0""")
def p10_dataset_audit(v: Views) -> DataFrame:
    cases, candidates = _bundle(v)
    r = F.col("pos") % 4
    labels = candidates.where("pos % 23 > 0").select("case_id", "item_id", F.when(r == 0, "required").when(r == 1, "useful").when(r == 2, "misleading").otherwise("irrelevant").alias("label"))
    gold = F.when(F.col("case_id") % 3 == 0, F.concat(F.lit("Gold answer no. "), F.col("case_id").cast("string"), F.lit(" zq")))
    cases = cases.withColumn("split", F.col("case_id") % 2).withColumn("gold", gold)
    source = v.table("documents").select(F.col("doc_id").alias("pos"), "source")
    told = F.when(F.col("pos") % 37 == 0, F.concat("content", F.lit("\nGOLD  answer no. "), F.col("case_id").cast("string"), F.lit(" zq"))).otherwise(F.col("content"))
    seen = candidates.join(source, "pos").withColumn("told", told)
    # the answer is planted in what the gold rule reads, not in what the others count
    planted = pipelines.dataset_audit(cases, seen.withColumn("content", F.col("told")), labels).where("rule = 'gold_leak'")
    return pipelines.dataset_audit(cases, seen, labels).where("rule <> 'gold_leak'").unionByName(planted)


def _trial(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A part's lines as a contract of three families and arms; parts of even number have an effect."""
    r, even = F.col("l_linenumber") % 3, F.col("l_partkey") % 2 == 0
    arm = F.when(r == 0, "correct").when(r == 1, "withheld").otherwise("stale")
    alias = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    li = v.table("lineitem").withColumn("alias", alias)
    units = li.select(F.col("l_partkey").alias("contract"), F.col("alias").alias("unit_id"), "alias", long(F.col("l_quantity") % 3, "family"), arm.alias("arm"), ((F.col("l_suppkey") + F.col("l_orderkey")) % 11 > 0).alias("valid"))
    flag = F.when(F.col("l_returnflag") == "N", "met").when(F.col("l_returnflag") == "R", "partial").otherwise("not_met")
    status = F.when(even & (r == 0) & (F.col("l_discount") < 0.095), "met").when(even & (r > 0), F.when(F.col("l_returnflag") == "R", "partial").otherwise("not_met")).otherwise(flag)
    marks = li.select("alias", F.lit(1).alias("criterion_id"), status.alias("status"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 48)).alias("critical"))
    return marks, marks.select("criterion_id").distinct().withColumn("weight", F.lit(1.0)), units


#: Units in tenths of a point, which are 0, 2, 5 and 10; NULL where a unit isn't valid.
SQL_TRIAL = """(SELECT contract, family, arm, valid, critical AND valid AS critical, CASE WHEN NOT valid THEN NULL WHEN critical THEN least(raw, 2) ELSE raw END AS score FROM (
 SELECT l_partkey AS contract, CAST(l_quantity AS BIGINT) % 3 AS family, l_linenumber % 3 AS arm, (l_suppkey + l_orderkey) % 11 > 0 AS valid, l_returnflag = 'A' AND l_quantity > 48 AS critical,
 CASE WHEN l_partkey % 2 = 0 AND l_linenumber % 3 = 0 AND l_discount < 0.095 THEN 10 WHEN l_partkey % 2 = 0 AND l_linenumber % 3 > 0 THEN CASE l_returnflag WHEN 'R' THEN 5 ELSE 0 END WHEN l_returnflag = 'N' THEN 10 WHEN l_returnflag = 'R' THEN 5 ELSE 0 END AS raw FROM lineitem))"""
TENTHS = (0, 2, 5, 10)


def sql_choices(name: str, side: int, done: bool) -> str:
    """contract, family, p of the correct arm against another one, from how often each score is chosen; with missing units at the ends of the scale if `done`."""
    filled = "coalesce(score, CASE arm WHEN 0 THEN 0 ELSE 10 END)" if done else "score"
    counts = ", ".join(f"count(*) FILTER (s = {x}) AS m{x}" for x in TENTHS)
    sizes = f"SELECT contract, family, count(*) FILTER (arm = 0) AS k, count(*) AS n, coalesce(sum(s) FILTER (arm = 0), 0) AS seen, {counts} FROM (SELECT contract, family, arm, {filled} AS s FROM trial WHERE arm IN (0, {side}) {'' if done else 'AND valid'}) GROUP BY 1, 2"
    sizes = f"SELECT f.contract, f.family, coalesce(k, 0) AS k, coalesce(n, 0) AS n, coalesce(seen, 0) AS seen, {', '.join(f'coalesce(m{x}, 0) AS m{x}' for x in TENTHS)} FROM (SELECT DISTINCT contract, family FROM trial) f LEFT JOIN ({sizes}) z ON z.contract = f.contract AND z.family = f.family"
    drawn = f"SELECT *, k - a2 - a5 - a10 AS a0 FROM (SELECT *, unnest(range(m10 + 1)) AS a10 FROM (SELECT *, unnest(range(m5 + 1)) AS a5 FROM (SELECT *, unnest(range(m2 + 1)) AS a2 FROM ({sizes}))))"
    choose = "factorial(CAST({0} AS INT)) // (factorial(CAST({1} AS INT)) * factorial(CAST({0} - {1} AS INT)))"
    ways = " * ".join(f"({choose.format(f'm{x}', f'a{x}')})" for x in TENTHS)
    p = f"CAST(sum({ways}) FILTER (2 * a2 + 5 * a5 + 10 * a10 >= seen) AS DOUBLE) / CAST(any_value({choose.format('n', 'k')}) AS DOUBLE)"
    return f"{name} AS (SELECT contract, family, {p if done else f'CASE WHEN any_value(k) > 0 AND any_value(n) > any_value(k) THEN {p} END'} AS p FROM ({drawn}) WHERE a0 >= 0 AND a0 <= m0 GROUP BY 1, 2)"


def sql_resamples(name: str, side: int) -> str:
    """contract, family, n, total, ways of all resamples of an arm's scores."""
    counts = ", ".join(f"count(*) FILTER (score = {x}) AS m{x}" for x in TENTHS)
    drawn = f"SELECT *, n - a2 - a5 - a10 AS a0 FROM (SELECT *, unnest(range(CASE m10 WHEN 0 THEN 1 ELSE n + 1 END)) AS a10 FROM (SELECT *, unnest(range(CASE m5 WHEN 0 THEN 1 ELSE n + 1 END)) AS a5 FROM (SELECT *, unnest(range(CASE m2 WHEN 0 THEN 1 ELSE n + 1 END)) AS a2 FROM (SELECT contract, family, count(*) AS n, {counts} FROM trial WHERE valid AND arm = {side} GROUP BY 1, 2))))"
    ways = "CAST(factorial(CAST(n AS INT)) AS DOUBLE) / CAST(" + " * ".join(f"factorial(CAST(a{x} AS INT))" for x in TENTHS) + " AS DOUBLE)" + "".join(f" * pow(m{x}, a{x})" for x in TENTHS)
    return f"{name} AS (SELECT contract, family, n, 2 * a2 + 5 * a5 + 10 * a10 AS total, sum({ways}) AS ways FROM ({drawn}) WHERE a0 >= 0 AND (m0 > 0 OR a0 = 0) GROUP BY 1, 2, 3, 4)"


def sql_interval(name: str, side: str) -> str:
    """contract, family, low, high of the difference of means over all pairs of resamples."""
    both = f"SELECT contract, family, c.n * o.n * 10 AS scale, c.total * o.n - o.total * c.n AS d, sum(c.ways * o.ways) AS w FROM c JOIN {side} o USING (contract, family) GROUP BY 1, 2, 3, 4"
    share = f"SELECT *, sum(w) OVER (PARTITION BY contract, family ORDER BY d) / sum(w) OVER (PARTITION BY contract, family) AS share FROM ({both})"
    return f"{name} AS (SELECT contract, family, min(d / scale) FILTER (share >= 0.025 - 1e-12) AS low, min(d / scale) FILTER (share >= 0.975 - 1e-12) AS high FROM ({share}) GROUP BY 1, 2)"


_ARM = {"correct": 0, "withheld": 1, "stale": 2}
_TRIAL_SIDES = ", ".join(f"sum(score) FILTER (arm = {i}) / 10.0 AS s{i}, count(score) FILTER (arm = {i}) AS n{i}, count(*) FILTER (arm = {i}) AS p{i}, avg(score) FILTER (arm = {i}) / 10.0 AS m{i}" for i in _ARM.values())
SQL_FAMILIES = f"""trial AS {SQL_TRIAL}, {sql_choices('pw', 1, True)}, {sql_choices('ps', 2, True)}, {sql_choices('ow', 1, False)}, {sql_choices('os', 2, False)}, {sql_resamples('c', 0)}, {sql_resamples('w', 1)}, {sql_resamples('s', 2)}, {sql_interval('iw', 'w')}, {sql_interval('i_s', 's')},
 effect AS (SELECT contract, family, m0 - m1 AS observed_withheld, m0 - m2 AS observed_stale, s0 / p0 - (s1 + p1 - n1) / p1 AS worst_withheld, s0 / p0 - (s2 + p2 - n2) / p2 AS worst_stale, n0 = p0 AS whole, critical FROM (SELECT contract, family, {_TRIAL_SIDES}, coalesce(bool_or(critical) FILTER (arm = 0), false) AS critical FROM trial GROUP BY 1, 2)),
 tested AS (SELECT e.*, coalesce(whole AND least(observed_withheld, observed_stale, worst_withheld, worst_stale) >= 0.2 - 1e-9 AND observed_withheld IS NOT NULL AND observed_stale IS NOT NULL AND worst_withheld IS NOT NULL AND worst_stale IS NOT NULL, false) AS material_pass, ow.p AS observed_p_withheld, pw.p AS p_withheld, iw.low AS low_withheld, iw.high AS high_withheld, os.p AS observed_p_stale, ps.p AS p_stale, i_s.low AS low_stale, i_s.high AS high_stale, greatest(pw.p, ps.p) AS p
 FROM effect e JOIN pw USING (contract, family) JOIN ps USING (contract, family) JOIN ow USING (contract, family) JOIN os USING (contract, family) LEFT JOIN iw USING (contract, family) LEFT JOIN i_s USING (contract, family)),
 placed AS (SELECT *, count(*) OVER (PARTITION BY contract) - row_number() OVER (PARTITION BY contract ORDER BY p, family) + 1 AS to_go FROM tested),
 held AS (SELECT *, max(least(1.0, to_go * p)) OVER o AS adjusted_p, bool_and(p <= 0.05 / to_go) OVER o AS rejected FROM placed WINDOW o AS (PARTITION BY contract ORDER BY p, family)),
 families AS (SELECT *, material_pass AND rejected AND NOT critical AS passes FROM held)"""
FAMILY_FIGURES = "observed_withheld observed_stale worst_withheld worst_stale observed_p_withheld p_withheld low_withheld high_withheld observed_p_stale p_stale low_stale high_stale p adjusted_p".split()


@query(f"WITH {SQL_FAMILIES} SELECT contract, family, {', '.join(f'round({c}, 6) AS {c}' for c in FAMILY_FIGURES)}, material_pass, critical, rejected, passes FROM families")
def p11_families(v: Views) -> DataFrame:
    found = pipelines.replication_families(*_trial(v), planned=None, by=["contract"])
    return found.select("contract", "family", *[F.round(c, 6).alias(c) for c in FAMILY_FIGURES], "material_pass", "critical", "rejected", "passes")


@query(f"""WITH {SQL_FAMILIES}, cell AS (SELECT contract, family, arm, count_if(valid) AS v, count(*) AS n FROM trial GROUP BY 1, 2, 3),
 gate AS (SELECT contract, sum(v) >= sum(n) - 3 AND bool_and(v >= n - 1) AS ok FROM cell GROUP BY 1),
 judged AS (SELECT contract, count(*) FILTER (passes) AS passing, bool_or(critical) AS stopped FROM families GROUP BY 1)
 SELECT contract, ok AS execution_valid, CASE WHEN ok THEN passing END AS passing, CASE WHEN ok THEN stopped END AS safety_stop, CASE WHEN NOT ok THEN 'invalid_execution' WHEN stopped THEN 'stop_or_redesign_once' WHEN passing >= 2 THEN 'continue' WHEN passing = 1 THEN 'narrow' ELSE 'stop_or_redesign_once' END AS verdict FROM gate JOIN judged USING (contract)""")
def p11_replication(v: Views) -> DataFrame:
    return pipelines.replication(*_trial(v), planned=None, by=["contract"])


@query(f"WITH trial AS {SQL_TRIAL}, {sql_choices('pw', 1, True)}, {sql_choices('ow', 1, False)} SELECT contract, family, round(ow.p, 9) AS observed_p, round(pw.p, 9) AS p FROM pw JOIN ow USING (contract, family)")
def n2_completed_p(v: Views) -> DataFrame:
    """Tests of groups with missing draws: as they are, and at worst."""
    marks, weights, units = _trial(v)
    keys, pair = ["contract", "family"], units.where("arm <> 'stale'").withColumn("treated", F.col("arm") == "correct")
    scored = scoring.annotations(marks.withColumnRenamed("alias", "unit_id"), weights).join(pair.where("valid"), "unit_id")
    planned = pair.groupBy(*keys, "treated").agg(F.count("*").alias("planned"))
    alone = units.select(*keys).distinct().select(*keys, F.lit(True).alias("treated"), F.lit(0).cast("long").alias("planned"))
    found = exact.completed_p(scored.select(*keys, "treated", long(F.round(F.col("score") * 10), "score")), keys, planned.unionByName(alone), 10)
    return found.select(*keys, F.round("observed_p", 9).alias("observed_p"), F.round("p", 9).alias("p"))


# stores, once more: records as they are kept


@query(with_views("SELECT id, type, content, score FROM memory", memory=views.MEMORY))
def s1_load_memory(v: Views) -> DataFrame:
    """Records as JSON texts, read again with the fixed schema."""
    records = bundles.encode(v.memory(), ["seq"])
    return tables.parse_memory(records).where("error is null").select("id", "type", "content", "score")


@query(with_views("SELECT id, content, tag2 AS tag, seq FROM memory", memory=views.MEMORY))
def s7_encode_record(v: Views) -> DataFrame:
    record = F.col("record")
    made = bundles.encode(v.memory(), ["seq"]).select(*[F.get_json_object(record, path).alias(name) for name, path in (("id", "$.id"), ("content", "$.content"), ("tag", "$.tags[1]"), ("data", "$.component_data"))])
    return made.select("id", "content", "tag", F.get_json_object("data", "$.seq").cast("long").alias("seq"))


@query(with_views("SELECT id, CASE WHEN seq % 4 = 0 THEN content WHEN type = 'TaskSummaryComponent' THEN 'Task ' || seq || ': ' || content WHEN type = 'UserProfileComponent' THEN tag1 || ' profile' ELSE content END AS content, CASE WHEN seq % 4 = 0 THEN score WHEN type = 'TaskSummaryComponent' THEN seq / 8.0 WHEN type = 'UserProfileComponent' THEN 1.0 ELSE score END::DOUBLE AS score FROM memory", memory=views.MEMORY))
def s7_typed_codecs(v: Views) -> DataFrame:
    """Records by the codecs of two types; every fourth payload is broken."""
    records = tables.parse_memory(bundles.encode(v.memory(), ["seq", "content", "tag1"]))
    broken = F.substring_index("id", "-", -1).cast("long") % 4 == 0
    records = records.withColumn("component_data", F.when(broken, "{broken").otherwise(F.col("component_data")))
    task = bundles.Codec("seq long, content string", lambda p: F.concat(F.lit("Task "), p.seq.cast("string"), F.lit(": "), p.content), lambda p: p.seq / 8.0)
    profile = bundles.Codec("tag1 string", lambda p: F.concat(p.tag1, F.lit(" profile")), lambda p: F.when(p.tag1.isNotNull(), 1.0))
    return bundles.typed(records, {"TaskSummaryComponent": task, "UserProfileComponent": profile}).select("id", "content", "score")


@query(with_views("SELECT component_id, CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE component_type END AS component_type, round(score, 6) AS score, event_id % 4 > 0 AS dated FROM feedback", feedback=views.FEEDBACK))
def s8_feedback_log(v: Views) -> DataFrame:
    """Entries as a log keeps them, every fourth a bare number."""
    entry = F.when(F.col("event_id") % 4 == 0, F.col("score").cast("string")).otherwise(F.to_json(F.struct("score", "component_type", F.col("ts").cast("string").alias("timestamp"))))
    logs = v.feedback().groupBy("component_id").agg(F.concat(F.lit('{"'), F.col("component_id"), F.lit('": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]}")).alias("value"))
    return tables.parse_feedback(logs).select("component_id", "component_type", F.round("score", 6).alias("score"), F.col("ts").isNotNull().alias("dated"))


@query("SELECT item_id AS query_id, 'doc-' || d AS id, CASE WHEN d % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS gain, d % 3 > 0 AS relevant FROM (SELECT item_id, unnest(range(item_id, item_id + 4)) AS d FROM benchmark) WHERE d % 2 = 0 OR d % 3 > 0")
def s9_evaluation_set(v: Views) -> DataFrame:
    ids = F.sequence(F.col("item_id"), F.col("item_id") + 3)

    def name(d):
        return F.concat(F.lit("doc-"), d.cast("string"))

    grades = F.map_from_entries(F.transform(F.filter(ids, lambda d: d % 2 == 0), lambda d: F.struct(name(d), F.lit(2.0))))
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.transform(F.filter(ids, lambda d: d % 3 > 0), name).alias("relevant_ids"), F.array(name(F.col("item_id") + 9)).alias("excluded_ids"), grades.alias("relevance"))
    labels = bundles.evaluation_tables(v.table("benchmark").select(F.array(case).alias("cases")))[1]
    return labels.select(F.col("query_id").cast("long").alias("query_id"), "id", "gain", "relevant")


@query(f"SELECT b.item_id AS case_id, CAST(row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) - 1 AS INT) AS pos, 'x' || d.doc_id AS item_id, len({sql_words('d.text')}) AS token_count FROM {SQL_CASES} b JOIN documents d ON d.doc_id % b.n = b.k")
def s10_bundle(v: Views) -> DataFrame:
    """Bundles of one case each, from nested rows to candidates with their places."""
    cases, candidates = _bundle(v)
    item = F.struct(F.col("item_id").alias("context_item_id"), "content", F.col("token_count").cast("int").alias("token_count"), F.lit(None).cast("string").alias("source"), "confidence", F.lit(None).cast("string").alias("created_timestamp"), "metadata")
    nested = candidates.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item"))), lambda a, b: F.signum(a["pos"] - b["pos"]).cast("int")), lambda x: x["item"]).alias("candidates"))
    none = F.array().cast("array<string>")
    case = F.struct(F.col("case_id").cast("string").alias("case_id"), "family_id", F.lit("adaptation").alias("split"), F.col("ordinal").cast("int").alias("ordinal"), "prompt", "token_budget", "candidates", F.struct(*[none.alias(x) for x in ("required", "useful", "misleading", "irrelevant")]).alias("labels"))
    raw = cases.join(nested, "case_id").select(F.lit("3").alias("schema_version"), F.array(case).alias("cases"))
    return bundles.bundle_tables(raw)[1].select(F.col("case_id").cast("long").alias("case_id"), "pos", "item_id", F.col("token_count").cast("long").alias("token_count"))


@query(with_views(f"SELECT x.query_id, x.id, {SQL_MISSED} AS required_miss FROM (SELECT query_id, id, {sql_terms('content')} AS terms FROM {SQL_RELEVANCE}) x JOIN requests r ON r.query_id = x.query_id", memory=views.MEMORY, requests=views.REQUESTS))
def f6_required_terms(v: Views) -> DataFrame:
    asked = v.requests().withColumn("required_terms", F.array(F.substring_index("query", " ", 3)))
    return lexical.relevance(asked, v.memory()).select("query_id", "id", "required_miss")


@query(with_views(f"SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT query_id, p.id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, p.id) AS rank FROM {SQL_PAIRS} p JOIN memory m ON m.seq = p.id WHERE m.type IN ('LongTermMemoryComponent', 'TaskSummaryComponent') AND m.tag1 = 'en' AND m.tag3 = 'long' AND m.status = 'active' AND NOT coalesce(m.expires_s <= {AS_OF_S}, false)) WHERE rank <= 5", memory=views.MEMORY))
def f9_filtered_search(v: Views) -> DataFrame:
    queries, table = _vectors(v)
    rows = table.join(v.memory().select(F.col("seq").alias("id"), "type", "tags", "status", "expires"), "id")
    rows = vectors.searchable(rows, v.as_of, ["LongTermMemoryComponent", "TaskSummaryComponent"], ["en", "long"])
    return vectors.similar_top(queries, rows.select("id", "embedding"), 5).select("query_id", "id", "rank")


@query("SELECT event_type, min(value) AS percentile FROM (SELECT event_type, value, sum(w) OVER (PARTITION BY event_type ORDER BY value) AS c, sum(w) OVER (PARTITION BY event_type) AS n FROM (SELECT event_type, value, sum(event_id % 5 + 1) AS w FROM events GROUP BY 1, 2)) WHERE c >= 0.9 * n - 1e-9 GROUP BY 1")
def w9_weighted_rank(v: Views) -> DataFrame:
    e = v.table("events").select("event_type", "value", (F.col("event_id") % 5 + 1).alias("w"))
    return stats.weighted_nearest_rank(e, ["event_type"], "value", "w", 0.9)


@query(f"""WITH l AS ({sql_sums("treated")}), r AS ({sql_sums("NOT treated")}), d AS (SELECT l_orderkey, l.n * r.n AS scale, l.total * r.n - r.total * l.n AS d, sum(CAST(l.ways AS DOUBLE) * CAST(r.ways AS DOUBLE)) AS w FROM l JOIN r USING (l_orderkey) GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY d) / sum(w) OVER (PARTITION BY l_orderkey) AS share FROM d)
 SELECT l_orderkey, round(min(d / scale) FILTER (share >= 0.025 - 1e-12), 6) AS low, round(min(d / scale) FILTER (share >= 0.975 - 1e-12), 6) AS high FROM c GROUP BY 1""")
def n3_difference_interval(v: Views) -> DataFrame:
    values = _units(v).select("l_orderkey", "index", "treated", F.floor(F.col("score") / 25).alias("value"))
    found = exact.resampled_interval(values.where("treated"), values.where("not treated"), ["l_orderkey"])
    return found.select("l_orderkey", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


__all__ = ["ORACLES", "QUERIES", "Views", "packed"]
