"""Arm summaries, paired effects and costs of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics of which less is better.
LOWER_IS_BETTER = ("selected_context_tokens", "provider_tokens", "latency_seconds", "cost_usd", "misleading_count", "irrelevant_count")


def strict_mean(value: str = "value") -> Column:
    """The mean, or null if one value is missing."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def long_form(metrics: DataFrame, names: list[str]) -> DataFrame:
    keys = [c for c in metrics.columns if c not in names]
    return metrics.unpivot(keys, names, "metric", "value")


def arm_summaries(long: DataFrame) -> DataFrame:
    """Means by phase, arm and metric, overall (family null) and for each family, in one pass."""
    return long.groupingSets([["phase", "arm_id", "metric"], ["phase", "arm_id", "family_id", "metric"]], "phase", "arm_id", "family_id", "metric").agg(strict_mean().alias("value"), F.count("*").alias("n"))


def paired_effects(long: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """effect = candidate less baseline for each task; the relative improvement is turned where less is better."""
    keys = ["phase", "repetition", "family_id", "case_id", "metric"]
    a, b = (long.where(F.col("arm_id") == arm).select(*keys, F.col("value").alias(name)) for arm, name in ((baseline, "baseline"), (candidate, "candidate")))
    x = a.join(b, keys).withColumn("effect", F.col("candidate") - F.col("baseline"))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    relative = F.when(F.col("baseline") != 0, sign * F.col("effect") / F.abs("baseline"))
    return x.withColumn("relative_improvement", relative).withColumn("reason", F.when(F.col("baseline") == 0, "zero_baseline"))


def unpaired(long: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Tasks that only one of the arms has."""
    keys = ["phase", "repetition", "family_id", "case_id", "metric"]
    a, b = (long.where(F.col("arm_id") == arm).select(*keys, F.lit(arm).alias(name)) for arm, name in ((baseline, "left_arm"), (candidate, "right_arm")))
    return a.join(b, keys, "full_outer").where("left_arm is null or right_arm is null").select(*keys, F.coalesce("left_arm", "right_arm").alias("arm_id"))


def trajectories(effects: DataFrame) -> DataFrame:
    """For each repetition the mean of the families' means, so that families weigh alike."""
    keys = ["phase", "repetition", "metric"]
    families = effects.groupBy(*keys, "family_id").agg(strict_mean("effect").alias("effect"))
    return families.groupBy(*keys).agg(strict_mean("effect").alias("effect"), F.count("*").alias("families"))


def summaries(trajectory: DataFrame) -> DataFrame:
    adverse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("effect") >= 0).otherwise(F.col("effect") <= 0)
    return trajectory.groupBy("phase", "metric").agg(strict_mean("effect").alias("mean_effect"), F.min("effect").alias("least"), F.max("effect").alias("most"), F.bool_or(adverse).alias("adverse_or_null"), F.count("*").alias("repetitions"))


def priced(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with the one rate that matches provider, model, revision (null equals null) and accounting; else an error.

    usage: usage_id and the four keys, input_tokens, cached_tokens, output_tokens. rates: the keys,
    input_rate, cached_rate, output_rate for a million tokens.
    """
    keys = ["provider", "model", "revision", "accounting"]
    on = [usage[k].eqNullSafe(rates[k]) for k in keys]
    hit = usage.join(rates, on, "left").select(usage["*"], "input_rate", "cached_rate", "output_rate")
    cost = ((F.col("input_tokens") - F.col("cached_tokens")) * F.col("input_rate") + F.col("cached_tokens") * F.col("cached_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6
    per = hit.groupBy("usage_id").agg(F.count("input_rate").alias("matches"), F.max(cost).alias("cost"))
    return per.select("usage_id", F.when(F.col("matches") == 1, F.col("cost")).alias("cost"), F.when(F.col("matches") == 0, "no_rate").when(F.col("matches") > 1, "several_rates").alias("error"))


#: The ratios of a task's metrics, as (metric, counted label sets, denominator).
RATIOS = (
    ("context_precision", ("required", "useful"), "selected"),
    ("context_recall", ("required", "useful"), "relevant"),
    ("required_context_recall", ("required",), "required"),
    ("misleading_selected_rate", ("misleading",), "selected"),
    ("irrelevant_selected_rate", ("irrelevant",), "selected"),
)


def task_metrics(labelled: DataFrame, outcomes: DataFrame, keys: list[str], threshold: float | None = None) -> DataFrame:
    """keys, metric, value, reason in long form.

    labelled (keys, item_id, label, selected, tokens) has every candidate; outcomes (keys, quality,
    success, scored, critical, severe, corrections, input_tokens, output_tokens, latency_ms,
    selector_ms, and cost where tokens have prices). A task that failed or wasn't scored has quality
    0; a ratio without denominator, and a cost without prices, has a reason.
    """
    chosen = F.col("selected")
    sums = [F.count_if(chosen).alias("n_selected"), F.sum(F.when(chosen, F.col("tokens")).otherwise(0)).alias("selected_context_tokens")]
    for label in ("required", "useful", "misleading", "irrelevant"):
        sums += [F.count_if(F.col("label") == label).alias(f"n_{label}"), F.count_if(chosen & (F.col("label") == label)).alias(f"s_{label}")]
    x = labelled.groupBy(*keys).agg(*sums).join(outcomes, keys)
    good = F.col("success") & F.col("scored")
    quality = F.when(good, F.col("quality")).otherwise(0.0)
    below = {"selected": F.col("n_selected"), "required": F.col("n_required"), "relevant": F.col("n_required") + F.col("n_useful")}
    values = {
        "task_quality": quality,
        "execution_success": F.col("success"),
        "scored_outcome": F.col("scored"),
        "critical_scoring_failure": F.col("critical"),
        "severe_scoring_failure": F.col("severe"),
        "correction_count": F.col("corrections"),
        "correction_required": F.col("corrections") > 0,
        "selected_context_tokens": F.col("selected_context_tokens"),
        "misleading_selected_count": F.col("s_misleading"),
        "irrelevant_selected_count": F.col("s_irrelevant"),
        "provider_input_tokens": F.col("input_tokens"),
        "provider_output_tokens": F.col("output_tokens"),
        "provider_latency_ms": F.col("latency_ms"),
        "selector_latency_ms": F.col("selector_ms"),
        "estimated_cost": F.col("cost") if "cost" in outcomes.columns else F.lit(None),
        "pass": F.col("scored") & (quality >= threshold) & ~F.col("critical") if threshold is not None else F.lit(None),
    }
    for name, labels, bottom in RATIOS:
        top = sum((F.col(f"s_{label}") for label in labels[1:]), F.col(f"s_{labels[0]}"))
        values[name] = F.when(below[bottom] > 0, top / below[bottom])
    wide = x.select(*keys, *[v.cast("double").alias(n) for n, v in values.items()])
    reason = F.when(F.col("value").isNull(), F.when(F.col("metric") == "pass", "pass_threshold_not_supplied").when(F.col("metric") == "estimated_cost", "pricing_not_supplied").otherwise("undefined_zero_denominator"))
    return wide.unpivot(keys, list(values), "metric", "value").withColumn("reason", reason)


def evidence_summary(states: DataFrame) -> DataFrame:
    """Learning evidence by arm, repetition and family: events, active and inactive targets."""
    return states.groupBy("arm_id", "repetition", "family_id").agg(F.sum("n").alias("events"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"))


def projected_cost(requests: DataFrame, input_rate: str, output_rate: str, cap: str) -> DataFrame:
    """total and whether it is within the cap: bytes and 1024 count as input tokens, the output limit as output; decimals throughout."""
    money = "decimal(20,6)"
    cost = (F.octet_length("body") + 1024).cast("decimal(20,0)") * F.lit(input_rate).cast("decimal(10,6)") + F.col("max_output_tokens").cast("decimal(20,0)") * F.lit(output_rate).cast("decimal(10,6)")
    return requests.agg(F.sum(cost).alias("micro")).select((F.col("micro").cast("decimal(26,6)")).alias("micro_total"), (F.col("micro") <= F.lit(cap).cast(money) * 1000000).alias("within_cap"))
