"""The test tables as memories, feedback, requests and so on: one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import substring
from ..scratch import materialise

MEMORY = """SELECT concat('doc-', CAST(doc_id AS VARCHAR(20))) AS id, doc_id AS seq,
 CASE doc_id % 5 WHEN 0 THEN 'LongTermMemoryComponent' WHEN 1 THEN 'TaskSummaryComponent' WHEN 2 THEN 'UserProfileComponent' WHEN 3 THEN 'AgentSessionComponent' ELSE 'DerivedMemoryComponent' END AS type,
 lang AS tag1, source AS tag2, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS tag3,
 text AS content, CAST(doc_id % 11 AS DOUBLE) / 5 AS score, 1704067200 + (doc_id % 720) * 3600 AS ts_s,
 CASE WHEN doc_id % 20 = 7 THEN 'superseded' WHEN doc_id % 20 = 13 THEN 'expired' ELSE 'active' END AS status,
 CASE WHEN doc_id % 10 = 4 THEN 1704067200 + (doc_id % 720) * 3600 + 864000 END AS expires_s,
 CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence FROM {documents}"""

FEEDBACK = """SELECT event_id, concat('doc-', CAST(user_id AS VARCHAR(20))) AS component_id,
 CASE user_id % 5 WHEN 0 THEN 'LongTermMemoryComponent' WHEN 1 THEN 'TaskSummaryComponent' WHEN 2 THEN 'UserProfileComponent' WHEN 3 THEN 'AgentSessionComponent' ELSE 'DerivedMemoryComponent' END AS component_type,
 value / 50 - 1 AS score, ts FROM {events}"""

REQUESTS = "SELECT item_id AS query_id, text AS query, 200 + 50 * (item_id % 5) AS token_budget FROM {benchmark}"

EVAL_LABELS = """SELECT b.item_id AS query_id, concat('doc-', CAST(d.doc_id AS VARCHAR(20))) AS id, CAST(1.0 + coalesce(l.quality, 0) AS DOUBLE) AS gain
 FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text) LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""

FB_ITEMS = """SELECT d.lang AS family_id, concat(d.lang, '-', d.source) AS case_id, CAST(substr(d.source, 4) AS INT) AS ordinal,
 concat('doc-', CAST(d.doc_id AS VARCHAR(20))) AS context_item_id,
 CASE WHEN d.n_chars > 1000 THEN 'format:runbook' ELSE 'format:note' END AS f1,
 CASE d.doc_id % 3 WHEN 0 THEN 'scope:bounded' WHEN 1 THEN 'scope:global' ELSE 'scope:local' END AS f2,
 CAST(CASE WHEN l.toxic = 1 THEN -1.0 WHEN l.quality = 1 THEN 1.0 END AS DOUBLE) AS reward
 FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id"""

TASK_METRICS = """SELECT CASE l.l_linestatus WHEN 'F' THEN 'adaptation' ELSE 'evaluation' END AS phase,
 CASE l.l_returnflag WHEN 'N' THEN 'static_policy' WHEN 'R' THEN 'adaptive_policy' ELSE 'full_context' END AS arm_id,
 l.l_linenumber AS repetition, o.o_orderpriority AS family_id, l.l_partkey % 20 AS case_id,
 round(avg(l.l_discount) * 10, 6) AS task_quality, round(avg(l.l_quantity), 6) AS selected_context_tokens
 FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3, 4, 5"""

PAGE_SOURCES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://records.example.gov/p' WHEN 1 THEN 'https://lib.example.edu/p' WHEN 2 THEN 'https://www.britannica.com/p' WHEN 3 THEN 'https://forum.example.com/p' WHEN 4 THEN 'https://www.totalwine.com/p' ELSE url END AS url, html FROM {pages}"""

#: 2024-02-01 00:00:00 UTC, the time at which queries on the test tables look.
AS_OF_S = 1706745600

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TEXTS = ("documents", "pages")


class Views:
    """Tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table; spark.ctxloom.deal names so many partitions that texts of one small file are dealt to first, as the benchmark does."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        parts = int(self.spark.conf.get("spark.ctxloom.deal", "0"))
        return df.repartition(parts) if parts and name in TEXTS else df

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    def memory(self) -> DataFrame:
        df = self.sql(MEMORY).withColumn("tags", F.array("tag1", "tag2", "tag3"))
        return df.withColumn("ts", F.timestamp_seconds("ts_s")).withColumn("expires", F.timestamp_seconds("expires_s"))

    def feedback(self) -> DataFrame:
        return self.sql(FEEDBACK).withColumn("ts", F.col("ts").cast("timestamp"))

    def requests(self) -> DataFrame:
        return self.sql(REQUESTS)

    def eval_labels(self) -> DataFrame:
        """EVAL_LABELS without its product: an automaton of a bounded number of passages reads each document."""
        needles = self.table("benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
        found = materialise(substring.scanned(needles, self.table("documents").select(F.col("doc_id").alias("text_id"), "text")), "labels")
        quality = self.table("labels").select(F.col("doc_id").alias("text_id"), "quality")
        gain = (1.0 + F.coalesce("quality", F.lit(0))).cast("double")
        return found.join(quality, "text_id", "left").select(F.col("needle_id").alias("query_id"), F.concat(F.lit("doc-"), F.col("text_id").cast("string")).alias("id"), gain.alias("gain"))

    @property
    def as_of(self):
        return F.timestamp_seconds(F.lit(AS_OF_S))


def duck(text: str) -> str:
    """A view's text for DuckDB, where the tables are known by name."""
    return text.format(**{t: t for t in TABLES})


def with_views(body: str, **views: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({duck(text)})" for name, text in views.items()) + " " + body
