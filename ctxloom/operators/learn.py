"""Feature utilities from feedback events, and what each task may see of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIOR_MEAN, PRIOR_WEIGHT, MIN_EVIDENCE = 0.0, 2.0, 2


def event_rewards(items: DataFrame, target: str) -> DataFrame:
    """family_id, case_id, ordinal, target, reward: a target counts once an event, by the mean over its items."""
    seen = items.where(F.col("reward").isNotNull()).select("family_id", "case_id", "ordinal", F.col(target).alias("target"), "reward") if target != "features" else items.where(F.col("reward").isNotNull()).select("family_id", "case_id", "ordinal", F.explode("features").alias("target"), "reward")
    return seen.groupBy("family_id", "case_id", "ordinal", "target").agg(F.avg("reward").alias("reward"))


def utilities(rewards: DataFrame, prior: float = PRIOR_MEAN, weight: float = PRIOR_WEIGHT, least: int = MIN_EVIDENCE) -> DataFrame:
    """family_id, target, utility, confidence, n, active and the events in order."""
    n = F.count("*")
    events = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "case_id"))), lambda x: x.case_id)
    return rewards.groupBy("family_id", "target").agg(((prior * weight + F.sum("reward")) / (weight + n)).alias("utility"), (n / (weight + n)).alias("confidence"), n.alias("n"), (n >= least).alias("active"), events.alias("source_event_ids"))


def as_of_states(rewards: DataFrame, prior: float = PRIOR_MEAN, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """What a task at each ordinal knows: only evidence of its family from smaller ordinals."""
    before = Window.partitionBy("family_id", "target").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    n, total = F.count("*").over(before), F.coalesce(F.sum("reward").over(before), F.lit(0.0))
    return rewards.select("family_id", "target", "ordinal", "case_id", n.alias("n"), ((prior * weight + total) / (weight + n)).alias("utility"))
