"""Score functions as Column expressions. Time is always an argument."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

HYBRID_WEIGHTS = {"semantic": 0.65, "importance": 0.20, "recency": 0.10, "feedback": 0.05}


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def norm_similarity(x: Column) -> Column:
    return clamp(x)


def norm_importance(x: Column) -> Column:
    positive = F.greatest(F.lit(0.0), x.cast("double"))
    return positive / (1.0 + positive)


def norm_feedback(x: Column) -> Column:
    return 0.5 + F.tanh(x) / 2.0


def norm_recency(ts: Column, as_of: Column, half_life_days: float = 30.0) -> Column:
    """Half after `half_life_days`; the future counts as now, no time as 0."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(ts)) / 86400e6)
    return F.when(ts.isNull() | (half_life_days <= 0), 0.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))


def hybrid(similarity: Column, score: Column, ts: Column, feedback: Column, as_of: Column, weights: Mapping[str, float] = HYBRID_WEIGHTS) -> Column:
    """Weighted mean of the four, in [0, 1]."""
    total = sum(weights.values())
    if any(w < 0 for w in weights.values()) or total <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    parts = norm_similarity(similarity) * weights["semantic"] + norm_importance(score) * weights["importance"] + norm_recency(ts, as_of) * weights["recency"] + norm_feedback(feedback) * weights["feedback"]
    return clamp(parts / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or one of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def goal_score(priority: Column, status: Column, progress: Column) -> Column:
    by_status = F.when(status == "active", 1.5).when(status == "completed", 0.3).when(status == "failed", 0.1).otherwise(1.0)
    return priority * by_status * F.when(progress > 0, 1 + progress).otherwise(1.0)


def session_score(success: Column, minutes: Column) -> Column:
    return F.when(success, 1.2).otherwise(0.8) * F.when(minutes > 60, 1.3).when(minutes > 30, 1.1).otherwise(1.0)


def decay(ts: Column, as_of: Column, half_life_minutes: float = 60.0) -> Column:
    return F.pow(F.lit(0.5), (F.unix_micros(as_of) - F.unix_micros(ts)) / 60e6 / half_life_minutes)


def confidence_bin(x: Column) -> Column:
    return F.when(x < 1 / 3, "confidence:low").when(x < 2 / 3, "confidence:medium").otherwise("confidence:high")
