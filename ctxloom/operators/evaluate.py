"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(results: DataFrame, labels: DataFrame, excluded: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Six metrics a query of results (query_id, id, rank, tokens) by labels (query_id, id, gain) and excluded (query_id, id).

    Empty denominators: precision 0, recall 1, NDCG 1, token efficiency 0, exclusion accuracy 1.
    """
    top = results.where(F.col("rank") <= k) if k else results
    hit = F.col("gain").isNotNull()
    judged = top.join(labels, ["query_id", "id"], "left").join(excluded.withColumn("_bad", F.lit(1)), ["query_id", "id"], "left")
    per = judged.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(hit, F.col("tokens")).otherwise(0)).alias("hit_tokens"),
        F.count("_bad").alias("bad"),
    )
    ideal = labels.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sort_array(F.collect_list("gain"), asc=False).alias("gains"))
    shunned = excluded.groupBy("query_id").agg(F.count("*").alias("excluded"))
    zero = F.lit(0)
    x = cases.select("query_id").join(per, "query_id", "left").join(ideal, "query_id", "left").join(shunned, "query_id", "left")
    n, relevant, bad_of = F.coalesce("n", zero), F.coalesce("relevant", zero), F.coalesce("excluded", zero)
    cut = F.slice("gains", F.lit(1), F.greatest(n.cast("int"), F.lit(1)))
    best = F.when((n > 0) & F.col("gains").isNotNull(), F.aggregate(F.transform(cut, lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    return x.select(
        "query_id",
        F.when(n > 0, F.col("hits") / n).otherwise(0.0).alias("precision"),
        F.when(relevant > 0, F.coalesce("hits", zero) / relevant).otherwise(1.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(best > 0, F.coalesce("dcg", F.lit(0.0)) / best).otherwise(1.0).alias("ndcg"),
        F.when(F.coalesce("tokens", zero) > 0, F.col("hit_tokens") / F.col("tokens")).otherwise(0.0).alias("token_efficiency"),
        F.when(bad_of > 0, (bad_of - F.coalesce("bad", zero)) / bad_of).otherwise(1.0).alias("exclusion_accuracy"),
    )


def stability(runs: DataFrame) -> DataFrame:
    """query_id, stability: mean Jaccard of run 1's ids (query_id, run, id) with each other run's."""
    sets = runs.groupBy("query_id", "run").agg(F.collect_set("id").alias("ids"))
    first = sets.where("run = 1").select("query_id", F.col("ids").alias("_first"))
    both = sets.where("run > 1").join(first, "query_id")
    union = F.size(F.array_union("ids", "_first"))
    return both.groupBy("query_id").agg(F.avg(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("ids", "_first")) / union)).alias("stability"))


def averages(metrics: DataFrame, utility: Column | None = None) -> DataFrame:
    """Means of all metrics and the number of cases; `utility`, a score of one case from its metrics, is averaged as well."""
    names = [c for c, kind in metrics.dtypes if kind == "double"]
    more = [F.avg(utility).alias("utility")] if utility is not None else []
    return metrics.agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("cases"), *more)
