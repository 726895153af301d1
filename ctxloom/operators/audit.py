"""Integrity checks as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, normalized_hash
from .filters import overdue
from .rank import numbered_in_spans

#: The grammar and vocabularies of reusable features.
FEATURE = r"^[a-z][a-z0-9_-]*:[a-z0-9][a-z0-9_-]*$"
RESERVED = "adaptation feedback gold heldout irrelevant label misleading required useful".split()
IDENTITY = "candidate contextitemid metadata provenance secret source".split()
NAMESPACES = "action basis capability confidence context_role format memory_kind presentation recency relevance scope signal tag task_family".split()


def feature_reason(feature: Column, candidate_ids: Column | None = None) -> Column:
    """Null for a feature that may be reused, else why not."""
    low = F.lower(feature)
    flat = F.regexp_replace(low, "[^a-z0-9]+", "")
    ids = F.transform(candidate_ids, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")) if candidate_ids is not None else F.array().cast("array<string>")

    def any_of(words: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(flat, w))

    return (
        F.when(any_of(RESERVED), "reserved_vocabulary")
        .when(any_of(IDENTITY) | low.rlike("(?:^|[^a-z0-9])i[^a-z0-9]*d(?:$|[^a-z0-9])"), "identity_vocabulary")
        .when(~feature.rlike(FEATURE), "grammar")
        .when(~F.substring_index(low, ":", 1).isin(NAMESPACES), "namespace")
        .when(F.exists(ids, lambda x: (x != "") & F.contains(flat, x)), "candidate_id")
    )


def record_reason(payload: Column, digest: Column, stamp: Column, version: Column, expected: str = "3") -> Column:
    """Null for a sound record, else the first fault."""
    return F.when(~version.eqNullSafe(F.lit(expected)), "version").when(~F.sha2(payload, 256).eqNullSafe(digest), "hash").when(~F.coalesce(stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"), F.lit(False)), "timestamp")


def missing_parents(children: DataFrame, parents: DataFrame, key: str, name: str, id_: str) -> DataFrame:
    """rule, id of the rows whose `key` no parent has."""
    return children.join(parents.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("rule"), F.col(id_).cast("string").alias("id"))


def label_audit(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, item_id, rule: an item with two labels, a label without candidate, a candidate without label."""
    keys = ["case_id", "item_id"]
    twice = labels.groupBy(*keys).agg(F.countDistinct("label").alias("n")).where("n > 1").select(*keys, F.lit("overlap").alias("rule"))
    stray = labels.select(*keys).distinct().join(candidates, keys, "left_anti").select(*keys, F.lit("unknown_item").alias("rule"))
    bare = candidates.select(*keys).join(labels, keys, "left_anti").select(*keys, F.lit("unlabelled").alias("rule"))
    return twice.unionByName(stray).unionByName(bare)


def split_leakage(cases: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """hash, n of normalised contents that stand in more than one split."""
    return cases.groupBy(normalized_hash(F.col(text)).alias("hash")).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1").select("hash", "n")


def coverage(planned: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Units that are missing, unplanned or repeated."""
    p = planned.select(*keys).distinct().withColumn("_p", F.lit(1))
    o = observed.groupBy(*keys).agg(F.count("*").alias("_o"))
    state = F.when(F.col("_o").isNull(), "missing").when(F.col("_p").isNull(), "unplanned").when(F.col("_o") > 1, "repeated")
    return p.join(o, keys, "full_outer").withColumn("state", state).where("state is not null").select(*keys, "state")


def polarity(marks: DataFrame) -> DataFrame:
    """case_id with the attributes that are only useful, only harmful, or both, of (case_id, attribute, polarity)."""
    useful, harmful = (F.collect_set(F.when(F.col("polarity") == x, F.col("attribute"))) for x in ("useful", "harmful"))
    per = marks.groupBy("case_id").agg(useful.alias("u"), harmful.alias("h"))
    return per.select("case_id", F.array_sort(F.array_except("u", "h")).alias("useful_only"), F.array_sort(F.array_except("h", "u")).alias("harmful_only"), F.array_sort(F.array_intersect("u", "h")).alias("ambiguous"))


def shortcuts(items: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Values of `key` that give the label away: they stand twice or more, with one label only."""
    return items.groupBy(key).agg(F.countDistinct(label).alias("labels"), F.count("*").alias("n")).where("labels = 1 and n > 1")


def hash_schedule(slots: DataFrame, seed: str, by: list[str] = ("case_id",)) -> DataFrame:
    """slots with a position inside each case, by a hash of seed, case, arm and repetition."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), *by, "arm_id", "repetition"), 256)
    return slots.withColumn("order_hash", order).withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("order_hash")))


def aliases(units: DataFrame, seed: str) -> DataFrame:
    """units with a block-wise random order (blocks by draw) and an opaque alias. Blocks are numbered by spans of the hash."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.lit("order"), "unit_id"), 256)
    alias = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("alias"), "unit_id"), 256), 1, 32)
    ordered = units.withColumn("alias", alias).withColumn("_order", order)
    placed = numbered_in_spans(ordered, ["draw"], ["_order"], F.substring("_order", 1, 2), "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).drop("_order")


def status(units: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("state") == s) for s in ("success", "failure", "pending")}
    return units.groupBy("run_id").agg(*[c.alias(s) for s, c in n.items()], F.when(n["pending"] == 0, "run_complete").otherwise("run_incomplete").alias("status"))


def comparable(manifests: DataFrame, fields: list[str]) -> DataFrame:
    """repetition, left_arm, right_arm, differing fields and valid, pairwise within a repetition (null equals null)."""
    left, right = (manifests.select("repetition", F.col("arm_id").alias(f"{x}_arm"), *[F.col(f).alias(f"_{x}_{f}") for f in fields]) for x in ("left", "right"))
    both = left.join(right, "repetition").where("left_arm < right_arm")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_left_{f}").eqNullSafe(F.col(f"_right_{f}")), F.lit(f)) for f in fields]))
    return both.select("repetition", "left_arm", "right_arm", differing.alias("differing"), (F.size(differing) == 0).alias("valid"))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def gold_leak(texts: Column, gold: Column, keys: Column, forbidden: list[str]) -> Column:
    """Whether a visible text holds the gold answer, or a metadata key is a forbidden one (both normalised)."""
    wanted = normalize(gold)
    told = F.exists(texts, lambda t: F.contains(normalize(t), wanted)) & (wanted != "")
    return told | F.exists(keys, lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(forbidden))


def annotation_coverage(successful: DataFrame, marks: DataFrame, criteria: list[str]) -> DataFrame:
    """alias, violation: successful aliases without marks, marks without success, other criteria than the rubric's."""
    wanted = F.array(*map(F.lit, criteria))
    seen = marks.groupBy("alias").agg(F.collect_set("criterion_id").alias("_c"))
    both = successful.withColumn("_s", F.lit(1)).join(seen, "alias", "full_outer")
    odd = (F.size(F.array_except("_c", wanted)) > 0) | (F.size(F.array_except(wanted, F.col("_c"))) > 0)
    why = F.when(F.col("_c").isNull(), "not_annotated").when(F.col("_s").isNull(), "not_successful").when(odd, "criteria")
    return both.withColumn("violation", why).where("violation is not null").select("alias", "violation")


def agent_stats(goals: DataFrame, as_of: Column) -> DataFrame:
    late = overdue(F.col("deadline"), as_of)
    return goals.groupBy("agent_id").agg(F.count("*").alias("total_goals"), F.count_if(F.col("status") == "active").alias("active_goals"), F.count_if(F.col("status") == "completed").alias("completed_goals"), F.count_if(late).alias("overdue_goals"))


def integrity_report(log: DataFrame) -> DataFrame:
    return log.groupBy("record_type").agg(F.count("*").alias("n"), F.count("reason").alias("violations"))


def resolve_aliases(marks: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks with their unit, marks of unknown aliases)."""
    known = units.select("alias", "unit_id")
    return marks.join(known, "alias"), marks.join(known, "alias", "left_anti")


def blind_export(outcomes: DataFrame, units: DataFrame, visible: list[str]) -> DataFrame:
    """Successful outcomes by alias with the visible columns alone; units and conditions don't show."""
    return outcomes.where(F.col("state") == "success").join(units.select("unit_id", "alias"), "unit_id").select("alias", *visible)


def design(cells: DataFrame, draws: int) -> DataFrame:
    """Every cell with every draw, each a unit."""
    return cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("unit_id", F.concat_ws("-", F.col("cell").cast("string"), F.col("draw").cast("string")))
