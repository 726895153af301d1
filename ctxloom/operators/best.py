"""The k best memories of each query by relevance and rank score, without scoring all that share a term.

Memories lie in blocks of about equal size and about equal score apart from relevance. A score known
to be reached k times then says how many terms a memory of a block must share with the query, and one that
shares so many has one of the query's rarest, so that only their postings are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..scratch import materialise
from . import lexical, rank, substring

#: Blocks per doubling of the number of terms, and per unit of the score apart from relevance.
SIZES, BASES = 2, 20
#: Postings of the rarest terms, for each of the k asked for, that give the first score to beat.
PROBES = 256
#: Scores are rounded to nine places; bounds allow for it.
SLACK = 1e-8


def _mixed(relevance: Column, base: Column, weights: Mapping[str, float]) -> Column:
    """A score, or its bound, of relevance and of the score without any."""
    return relevance * (weights["relevance"] / sum(weights.values())) + base


def _relevance(overlap: Column, asked: Column, size: Column, inner: Column) -> Column:
    """The largest relevance with so many common terms: the bonus needs all inner terms of the query."""
    return F.least(F.lit(1.0), overlap / F.sqrt(asked * size) + F.when(overlap >= inner, lexical.PHRASE_BONUS).otherwise(0.0))


def prepared(memory: DataFrame, weights: Mapping[str, float] = rank.WEIGHTS) -> DataFrame:
    """id, seq, importance, recency, terms, size, base, block of memories (id, seq, content, importance, recency).

    Written once; many searches can read it. Memories without a term have size 0 and no block.
    """
    zero = F.lit(0.0)
    base = rank.score(zero, F.coalesce("importance", zero), F.coalesce("recency", zero), F.lit(True), weights)
    rows = memory.select("id", "seq", F.coalesce("importance", zero).alias("importance"), F.coalesce("recency", zero).alias("recency"), terms(F.col("content")).alias("terms"))
    rows = rows.withColumn("size", F.size("terms")).withColumn("base", base)
    block = F.floor(F.log2(F.col("size").cast("double")) * SIZES) * 1000 + F.floor(F.col("base") * BASES)
    return materialise(rows.withColumn("block", F.when(F.col("size") > 0, block)), "prepared")


def best(queries: DataFrame, memory: DataFrame, k: int, table: DataFrame | None = None, weights: Mapping[str, float] = rank.WEIGHTS) -> DataFrame:
    """query_id, id, relevance, score, rank of the k best memories of each query: as rank.top_k of all pairs with relevance above 0.

    `table` is prepared(memory, weights), made here if not given. Ids are unique on both sides.
    Null and empty texts share nothing. Equal scores are ranked by seq; none of them is lost, as
    a bound leaves out only what is certainly below k others. A query with fewer than k memories by its
    rare terms is compared with all that share any.
    """
    table = prepared(memory, weights) if table is None else table
    postings = table.where("block is not null").select(F.explode("terms").alias("term"), "block", "id", "size", "base")
    asked = queries.select("query_id", F.lower("query").alias("text"), terms(F.col("query")).alias("own")).where(F.size("own") > 0)
    tokens = F.regexp_extract_all(F.col("text"), F.lit("[a-z0-9]+"), 0)
    inner = F.array_intersect(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), F.col("own"))
    asked = materialise(asked.withColumn("inner", F.size(inner)).withColumn("asked", F.size("own")), "asked")
    words = asked.select("query_id", F.explode("own").alias("term"))
    counts = postings.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "term")
    # r: place of a term among those of its query that any memory has, rarest first
    places = words.join(counts, "term").withColumn("r", F.row_number().over(order)).withColumn("_upto", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = materialise(places, "places")

    rows = table.select("id", "seq", "importance", "recency", "terms", "size", "base")

    def scored(pairs: DataFrame) -> DataFrame:
        """overlap and the score without the bonus of pairs (query_id, id).

        A pair has few bytes and much work, so it is dealt to a number of tasks that AQE doesn't lessen.
        """
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = pairs.repartition(parts, "query_id", "id").join(asked.select("query_id", "own", "asked", "inner"), "query_id").join(rows, "id")
        both = both.withColumn("overlap", F.size(F.array_intersect("own", "terms"))).drop("own", "terms")
        plain = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("overlap") / F.sqrt(F.col("asked") * F.col("size"))))
        return both.withColumn("_plain", plain)

    # memories that share rare terms, the best of them by those alone, then by all terms
    probe = places.where((F.col("r") == 1) | (F.col("_upto") <= PROBES * k)).select("query_id", "term")
    shared = postings.join(probe, "term").groupBy("query_id", "id", "size", "base").agg(F.count("*").alias("_n")).join(asked.select("query_id", "asked"), "query_id")
    by_probe = Window.partitionBy("query_id").orderBy(F.desc(_mixed(F.col("_n") / F.sqrt(F.col("asked") * F.col("size")), F.col("base"), weights)))
    first = scored(shared.withColumn("_n", F.row_number().over(by_probe)).where(F.col("_n") <= 4 * k).select("query_id", "id"))
    first = first.select("query_id", _mixed(F.col("_plain"), F.col("base"), weights).alias("least"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least")))
    reached = materialise(first.withColumn("_n", nth).where(F.col("_n") == k).select("query_id", "least"), "reached")

    # how many terms must be common in each block; there are at most 62 levels of size and 21 of base
    blocks = table.where("block is not null").groupBy("block").agg(F.min("size").alias("_small"), F.max("size").alias("_large"), F.max("base").alias("_base"))
    every = blocks.agg(F.collect_list(F.struct("block", "_small", "_large", "_base"))).scalar()
    known = places.groupBy("query_id").agg(F.max("r").alias("found"))
    limits = asked.select("query_id", "asked", "inner").join(known, "query_id").join(reached, "query_id", "left")
    per = limits.select("*", F.inline(every))
    # the relevance that is needed, and the number of terms that gives it, with the bonus or without
    share = weights["relevance"] / sum(weights.values())
    needed = (F.col("least") - SLACK - F.col("_base")) / share if share else F.lit(0.0)
    norm = F.sqrt(F.col("asked") * F.col("_small"))
    plain = F.ceil(needed * norm - SLACK)
    phrase = F.greatest(F.col("inner"), F.ceil((needed - lexical.PHRASE_BONUS) * norm - SLACK))
    per = per.withColumn("_needed", needed).withColumn("need", F.when(F.col("least").isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(plain, phrase))).cast("int"))
    per = per.where(F.col("_needed").isNull() | (F.col("_needed") <= 1)).where((F.col("need") <= F.col("found")) & (F.col("need") <= F.col("_large")))
    per = per.withColumn("upto", F.col("found") - F.col("need") + 1)
    keys = places.select("query_id", "term", "r").join(per.select("query_id", "block", "upto", "found", "asked", "inner", "least"), "query_id").where("r <= upto").drop("r")
    # postings that no query asks for are left out before the shuffle, if what is asked for is small enough to be sent to them
    keys = materialise(keys, "keys")
    asked_for = postings.join(keys.select("term", "block").distinct(), ["term", "block"], "left_semi")
    hits = asked_for.join(keys, ["term", "block"]).groupBy("query_id", "id").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("size", "base", "found", "upto", "asked", "inner", "least")])
    # terms that were not looked up could all be there
    most = F.least(F.col("size").cast("long"), F.col("_n") + F.col("found") - F.col("upto"))
    possible = hits.where(F.col("least").isNull() | (_mixed(_relevance(most, F.col("asked"), F.col("size"), F.col("inner")), F.col("base"), weights) >= F.col("least") - SLACK))
    pairs = possible.select("query_id", "id")
    short = asked.where("inner = 0").select(F.col("query_id").alias("needle_id"), F.col("text").alias("needle"))
    if not short.isEmpty():
        pairs = pairs.unionByName(substring.holding(short, memory.select(F.col("id").alias("text_id"), F.lower("content").alias("text"))).toDF("query_id", "id")).distinct()
    full = scored(pairs).join(reached, "query_id", "left")
    bound = _mixed(F.when(F.col("size") == 0, 0.0).otherwise(_relevance(F.col("overlap"), F.col("asked"), F.col("size"), F.col("inner"))), F.col("base"), weights)
    full = materialise(full.where(F.col("least").isNull() | (bound >= F.col("least") - SLACK)), "possible")
    # contents join only where the query may stand in a text as it is
    near = full.where("overlap >= inner and size > 0").select("query_id", "id").join(asked.select("query_id", "text"), "query_id").join(memory.select("id", F.lower("content").alias("_content")), "id")
    held = near.where(F.contains("_content", F.col("text"))).select("query_id", "id", F.lit(lexical.PHRASE_BONUS).alias("_bonus"))
    relevance = F.least(F.lit(1.0), F.col("_plain") + F.coalesce("_bonus", F.lit(0.0)))
    out = full.join(held, ["query_id", "id"], "left").withColumn("relevance", relevance).where("relevance > 0")
    out = out.withColumn("score", F.round(rank.score(F.col("relevance"), F.col("importance"), F.col("recency"), F.lit(True), weights), 9))
    return rank.top_k(out, k).select("query_id", "id", "relevance", "score", "rank")
