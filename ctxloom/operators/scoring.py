"""Rubric scores of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP_SHARE = {"met": 1.0, "partial": 0.5}
CRITICAL_CAP = 0.20


def rubric(steps: DataFrame, findings: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row an output.

    steps (output_id, criterion_id, points, status, cap, critical), findings (output_id,
    criterion_id, present, deduction, cap, severe), criteria (output_id, criterion_id, weight). A
    criterion is its met points less deductions, within 0 and its points; the mean by weight is
    held below every cap that a step not met or a finding present sets off. An unresolved status
    leaves all scores open.
    """
    missed = F.col("status").isin("not_met", "contradicted")
    s = steps.groupBy("output_id", "criterion_id").agg(
        F.sum("points").alias("most"),
        F.sum(F.when(F.col("status") == "met", F.col("points")).otherwise(0.0)).alias("met"),
        F.min(F.when(missed, F.col("cap"))).alias("step_cap"),
        F.count_if(F.col("status") == "unresolved").alias("open"),
        F.count_if(F.col("critical") & (F.col("status") != "met")).alias("critical"),
    )
    f = findings.groupBy("output_id", "criterion_id").agg(
        F.sum(F.when(F.col("present"), F.col("deduction")).otherwise(0.0)).alias("off"),
        F.min(F.when(F.col("present"), F.col("cap"))).alias("finding_cap"),
        F.count_if(F.col("present") & F.col("severe")).alias("severe"),
    )
    x = criteria.join(s, ["output_id", "criterion_id"], "left").join(f, ["output_id", "criterion_id"], "left")
    raw = F.greatest(F.lit(0.0), F.least(F.col("most"), F.col("met") - F.coalesce("off", F.lit(0.0))))
    share = F.when(F.col("most") > 0, raw / F.col("most")).otherwise(0.0)
    out = x.withColumn("share", share).groupBy("output_id").agg(
        (F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("base"),
        F.least(F.min("step_cap"), F.min("finding_cap")).alias("cap"),
        F.sum(F.coalesce("open", F.lit(0))).alias("open"),
        F.sum(F.coalesce("critical", F.lit(0))).alias("critical_omissions"),
        F.sum(F.coalesce("severe", F.lit(0))).alias("severe_findings"),
    )
    settled = F.col("open") == 0
    score = F.when(settled, F.least("base", F.coalesce("cap", F.lit(1.0))))
    return out.select("output_id", F.when(settled, "scored").otherwise("needs_adjudication").alias("state"), F.when(settled, F.col("base")).alias("base_quality"), score.alias("quality"), "critical_omissions", "severe_findings")


def annotations(marks: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight times status of (unit_id, criterion_id, status, critical); a critical finding caps it."""
    share = F.when(F.col("status") == "met", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    per = marks.join(weights, "criterion_id").groupBy("unit_id").agg(F.sum(F.col("weight") * share).alias("raw"), F.bool_or("critical").alias("critical"))
    return per.select("unit_id", F.when(F.col("critical"), F.least("raw", F.lit(CRITICAL_CAP))).otherwise(F.col("raw")).alias("score"), "critical")
