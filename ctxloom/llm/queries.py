"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_extract, jaccard_join, langid, lexical_search, lm, packing, prefix_trie, quality, sharding, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.shard(rows, "doc_id", 16, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))
    out = nodes.join(prefix_trie.member_digests(ends), prefix_trie.NODE, "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


OP11_SQL = """
WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, r, len(w) AS n, w FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, corpus),
shape AS (SELECT r, doc_id, 75 + (25 * n * docs) // length AS m FROM docs, corpus),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM items JOIN weight USING (term) JOIN tf USING (term) JOIN shape USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""

#: crc32 of a decimal id, bit by bit, as DuckDB has no such function; 3988292384 is the reversed polynomial, a fixed value.
CRC32 = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)))"

OP12_SQL = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, turns, {CRC32} % 6 AS h FROM own),
path AS (SELECT c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), c.turns[c.h + 1:]) AS p FROM cut c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (SELECT conv_id, len(p) AS length, d, p[1:d] AS node FROM path, unnest(range(len(p) + 1)) AS x(d)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '') AS ends FROM prefix GROUP BY node, d),
kid AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[n.d].t) END AS saved FROM node n LEFT JOIN kid k ON k.node = n.node AND k.d = n.d),
up AS (SELECT node[1:a] AS node, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM full_node, unnest(range(d + 1)) AS x(a) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN up u ON u.node = n.node AND u.d = n.d LEFT JOIN node p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""

OP13_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256 FROM t WINDOW g AS (PARTITION BY norm)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_html_extraction": op7_html_extraction,
        "op8_quality_rules": op8_quality_rules,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_packing": op10_packing,
        "op11_lexical_search": op11_lexical_search,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_exact_dedup": OP13_SQL}
