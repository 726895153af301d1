"""Context selection policies over many cases: full, similar, static and adaptive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence_bin
from ..functions.text import terms
from ..scratch import materialise
from . import audit, lexical, rank
from .learn import MIN_EVIDENCE, PRIOR_MEAN, PRIOR_WEIGHT

APPROVED = ("control_attributes", "format", "learning_attributes")


def visible_features(candidates: DataFrame) -> DataFrame:
    """candidates (case_id, pos, item_id, confidence, metadata map<string, array<string>>) with `features` and `unsafe`.

    Features come from three approved fields and the confidence's bin; one unsafe feature marks the
    candidate, the others still rank. Ids of a case that stand in its features are found by a join of
    the distinct features' substrings with the ids, so that no row meets all ids of its case.
    """
    named = F.flatten(F.array(*[F.coalesce(F.col("metadata")[f], F.array().cast("array<string>")) for f in APPROVED]))
    all_ = candidates.withColumn("_named", named)
    all_ = _beside_leaks(all_, candidates.select("case_id", "item_id"))
    bad = F.col("_leaks") | F.exists("_named", lambda f: audit.feature_reason(f).isNotNull())
    stray = F.exists(F.coalesce(F.col("metadata")["format"], F.array().cast("array<string>")), lambda f: ~F.startswith(f, F.lit("format:")))
    return all_.withColumn("features", F.array_sort(F.array_distinct(F.concat("_named", F.array(confidence_bin(F.col("confidence"))))))).withColumn("unsafe", bad | stray).drop("_leaks", "_named")


def _beside_leaks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (case_id, _named) with `_leaks`: one of the features holds an id (case_id, item_id) of the case, by letters and digits alone."""

    def flat(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")

    own = ids.select("case_id", flat(F.col("item_id")).alias("_part")).where("_part <> ''").distinct()
    sets = rows.select("case_id", "_named").distinct()
    features = sets.select("case_id", F.explode("_named").alias("_f")).distinct().where(audit.feature_reason(F.col("_f")).isNull())
    n = F.length(flat(F.col("_f")))
    places = F.explode(F.sequence(F.lit(1), n)).alias("_from")
    parts = features.where(n > 0).select("case_id", "_f", places).select("case_id", "_f", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("_from") + 1), lambda k: F.substring(flat(F.col("_f")), F.col("_from"), k))).alias("_part"))
    same = parts["case_id"].eqNullSafe(own["case_id"]) & (parts["_part"] == own["_part"])
    found = parts.join(own, same, "left_semi").select(F.col("case_id").alias("_case"), F.col("_f").alias("_leak")).distinct()
    held = sets.select("case_id", "_named", F.explode("_named").alias("_f"))
    held = held.join(found, held["case_id"].eqNullSafe(found["_case"]) & (held["_f"] == found["_leak"])).select(F.col("case_id").alias("_case"), F.col("_named").alias("_set"), F.lit(True).alias("_leaks")).distinct()
    beside = rows.join(held, rows["case_id"].eqNullSafe(held["_case"]) & (rows["_named"] == held["_set"]), "left")
    return beside.withColumn("_leaks", F.coalesce("_leaks", F.lit(False))).drop("_case", "_set")


def static_scores(candidates: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """raw: the weighted confidence and the weights of the visible features."""
    raw = F.col("confidence") * weights.get("confidence", 0.0)
    for feature, weight in sorted(weights.items()):
        if feature != "confidence":
            raw = raw + F.when(F.array_contains("features", feature), weight).otherwise(0.0)
    return candidates.withColumn("raw", raw)


def adaptive_scores(candidates: DataFrame, utilities: DataFrame, weight: float = 1.0) -> DataFrame:
    """raw more the utilities of its features: those of the family (family_id, target, utility, active) or of the case (case_id, feature, utility)."""
    if "case_id" in utilities.columns:
        known, keys = utilities, ["case_id", "feature"]
    else:
        known, keys = utilities.where("active").select("family_id", F.col("target").alias("feature"), "utility"), ["family_id", "feature"]
    learned = candidates.select("case_id", "item_id", "family_id", F.explode("features").alias("feature")).join(known, keys).groupBy("case_id", "item_id").agg(F.sum("utility").alias("_u"))
    return candidates.join(learned, ["case_id", "item_id"], "left").withColumn("raw", F.round(F.col("raw") + weight * F.coalesce("_u", F.lit(0.0)), 12)).drop("_u")


def prefix_utilities(cases: DataFrame, rewards: DataFrame, prior: float = PRIOR_MEAN, weight: float = PRIOR_WEIGHT, least: int = MIN_EVIDENCE) -> DataFrame:
    """case_id, feature, utility: what each case (case_id, family_id, ordinal) may know, from events of its family with smaller ordinals alone."""
    seen = rewards.select("family_id", F.col("target").alias("feature"), F.col("ordinal").alias("_before"), "reward")
    known = cases.select("case_id", "family_id", "ordinal").join(seen, "family_id").where(F.col("_before") < F.col("ordinal"))
    n = F.count("*")
    return known.groupBy("case_id", "feature").agg(((prior * weight + F.sum("reward")) / (weight + n)).alias("utility"), n.alias("n")).where(F.col("n") >= least).drop("n")


def prepared(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with features, family and relevance to their own case's prompt, written once without their contents, as every mode reads them several times."""
    both = candidates.join(cases.select("case_id", "family_id", "prompt"), "case_id")
    both = both.withColumn("_q", terms(F.col("prompt"))).withColumn("_m", terms(F.col("content")))
    shared, sizes = F.size(F.array_intersect("_q", "_m")), F.size("_q") * F.size("_m")
    bonus = F.when(F.contains(F.lower("content"), F.lower("prompt")), lexical.PHRASE_BONUS).otherwise(0.0)
    relevance = F.coalesce(F.when(sizes == 0, 0.0).otherwise(F.least(F.lit(1.0), shared / F.sqrt(sizes) + bonus)), F.lit(0.0))
    # contents end here, before any shuffle
    rows = both.select("case_id", "pos", "item_id", "token_count", "confidence", "metadata", "family_id", relevance.alias("relevance"))
    seen = visible_features(rows)
    return materialise(seen.select("case_id", "pos", "item_id", "token_count", "confidence", "features", "unsafe", "family_id", "relevance"), "candidates")


def select(cases: DataFrame, candidates: DataFrame, mode: str, *, weights: Mapping[str, float] | None = None, utilities: DataFrame | None = None, k: int = 5, relevance_weight: float = 0.7, importance_weight: float = 0.3, seen: DataFrame | None = None) -> DataFrame:
    """One decision for every candidate.

    cases (case_id, family_id, prompt, token_budget), candidates (case_id, pos, item_id, content,
    token_count, confidence, metadata). Raw policy scores are dense-ranked inside each case; the
    candidates' own token counts are authoritative. `seen`: what prepared() gave, for several modes.
    """
    seen = prepared(cases, candidates) if seen is None else seen
    if mode == "full_context":
        scored = seen.withColumn("score", F.lit(0.0)).withColumn("unsafe", F.lit(False))
    else:
        if mode == "similarity_top_k":
            scored = seen.withColumn("score", F.col("relevance")).withColumn("unsafe", F.lit(False))
        else:
            raw = static_scores(seen, weights or {})
            if mode == "adaptive_policy":
                raw = adaptive_scores(raw, utilities)
            safe = rank.pool_rank(raw.where("not unsafe"), ["case_id"], "raw", "importance").unionByName(raw.where("unsafe").withColumn("importance", F.lit(0.0)))
            total = relevance_weight + importance_weight
            scored = safe.withColumn("score", F.round((F.col("relevance") * relevance_weight + F.col("importance") * importance_weight) / total, 12))
    ranked = rank.rank(scored.where("not unsafe"), ["case_id"], "score", "pos")
    top = ranked.where(F.col("rank") <= k) if mode == "similarity_top_k" else ranked
    ready = top.join(cases.select("case_id", "token_budget"), "case_id").select(F.col("case_id").alias("query_id"), F.col("item_id").alias("id"), "rank", F.col("token_count").alias("tokens"), "token_budget", F.lit(1.0).alias("relevance"), F.lit(0.0).alias("min_relevance"), F.lit(False).alias("required_miss"))
    packed = rank.pack(ready).select(F.col("query_id").alias("case_id"), F.col("id").alias("item_id"), "included", "reason", "tokens")
    left = [scored.where("unsafe").select("case_id", "item_id", F.lit("processing_error").alias("reason"), F.col("token_count").cast("int").alias("tokens"))]
    if mode == "similarity_top_k":
        left.append(ranked.where(F.col("rank") > k).select("case_id", "item_id", F.lit("max_components").alias("reason"), F.col("token_count").cast("int").alias("tokens")))
    for rows in left:
        packed = packed.unionByName(rows.withColumn("included", F.lit(False)))
    return packed
