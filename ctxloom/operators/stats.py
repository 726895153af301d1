"""Corrections for many tests, percentiles, bootstraps and the gates of an experiment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .rank import numbered_in_spans, spans


def ordered_mean(df: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """by and the mean of `value`, summed up from left to right in a stated order.

    Doubles that are added in the order in which shuffles end differ in their last bits from run to run, and
    equal groups then no longer tie. A group passes by as a stream; nulls don't count.
    """
    order_ = Window.partitionBy(*by).orderBy(*order)
    running = order_.rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(*by, F.row_number().over(order_).alias("_i"), F.sum(value).over(running).alias("_sum"), F.count(value).over(running).alias("_n"))
    last = sums.groupBy(*by).agg(F.max(F.struct("_i", "_sum", "_n")).alias("_last"))
    return last.select(*by, F.try_divide("_last._sum", "_last._n").alias(name))


def holm(tests: DataFrame, alpha: float = 0.05, by: list[str] = (), few: bool = False) -> DataFrame:
    """tests (name, p) with Holm's adjusted p and rejection, which stops at the first failure.

    Tests are ranked and their running figures taken by spans of (p, name), so that a task holds a
    span and not a group. They are read several times, so they are written once: figures that differ from one
    reading to the next would not give ranks. `few`: a group's tests are few by nature, and one window does.
    """
    by, order = list(by), ["p", "name"]
    if few:
        whole = Window.partitionBy(*by)
        running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ranked = tests.withColumn("r", F.row_number().over(whole.orderBy(*order))).withColumn("_left", F.count("*").over(whole) - F.col("r") + 1)
        failed = F.when(F.col("p") <= alpha / F.col("_left"), 0).otherwise(1)
        return ranked.select(*by, "name", "p", "r", F.max(F.least(F.lit(1.0), F.col("_left") * F.col("p"))).over(running).alias("adjusted"), (F.max(failed).over(running) == 0).alias("rejected"))
    tests = materialise(tests.select(*by, "name", "p"), "tests")
    ranked = numbered_in_spans(tests.withColumn("_at", spans(tests, order)), by, order, F.col("_at"), "_n").withColumn("r", (F.col("_n") + 1).cast("int"))
    ranked = _beside(ranked, ranked.groupBy(*by).agg(F.count("*").alias("m")), by)
    left = F.col("m") - F.col("r") + 1
    ranked = ranked.withColumn("_scaled", F.least(F.lit(1.0), left * F.col("p"))).withColumn("_ok", F.when(F.col("p") <= alpha / left, 1).otherwise(0))
    ahead = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy(*by, "_at").agg(F.max("_scaled").alias("_most"), F.min("_ok").alias("_all"))
    parts = parts.select(*by, "_at", F.max("_most").over(ahead).alias("_most"), F.min("_all").over(ahead).alias("_all"))
    running = Window.partitionBy(*by, "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = _beside(ranked, parts, [*by, "_at"])
    adjusted = F.greatest(F.max("_scaled").over(running), "_most")
    return both.select(*by, "name", "p", "r", adjusted.alias("adjusted"), (F.least(F.min("_ok").over(running), "_all") == 1).alias("rejected"))


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group; nulls are a group."""
    if not by:
        return rows.join(F.broadcast(groups))  # one row
    renamed = groups.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(by)})
    same = reduce(Column.__and__, (rows[c].eqNullSafe(renamed[f"_of_{i}"]) for i, c in enumerate(by)))
    return rows.join(renamed, same).drop(*(f"_of_{i}" for i in range(len(by))))


def nearest_rank(df: DataFrame, by: list[str], value: str, p: float, few: bool = False) -> DataFrame:
    """The ceil(p n)-th smallest value of each group; values are counted before they meet."""
    return weighted_nearest_rank(df.withColumn("_w", F.lit(1)), by, value, "_w", p, 1e-12, few)


def weighted_nearest_rank(df: DataFrame, by: list[str], value: str, weight: str, p: float, slack: float = 1e-9, few: bool = False) -> DataFrame:
    """The least value up to which a share of p of the group's weight lies; null values are left out.

    The span of values in which a group's percentile lies is found from the weights of spans, and
    only its values are summed up one by one. `few`: a group's values are few by nature, and one
    window does.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    if few:
        running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        sums = counts.withColumn("_c", F.sum("_w").over(running)).withColumn("_need", p * F.sum("_w").over(Window.partitionBy(*by)) - slack)
        return sums.where(F.col("_c") >= F.col("_need")).groupBy(*by).agg(F.min(value).alias("percentile"))
    counts = counts.withColumn("_at", spans(counts, [value]))
    ahead = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*by, "_at").agg(F.sum("_w").alias("_part"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(ahead), F.lit(0))).withColumn("_need", p * F.sum("_part").over(Window.partitionBy(*by)) - slack)
    reached = parts.where(F.col("_before") + F.col("_part") >= F.col("_need"))
    first = reached.groupBy(*by).agg(F.min(F.struct("_at", "_before", "_need")).alias("_f")).select(*by, "_f.*")
    inside = Window.partitionBy(*by, "_at").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = _beside(counts, first, [*by, "_at"]).withColumn("_c", F.col("_before") + F.sum("_w").over(inside))
    return sums.where(F.col("_c") >= F.col("_need")).groupBy(*by).agg(F.min(value).alias("percentile"))


def hex_mod(digest: Column, n: Column) -> Column:
    """A hexadecimal SHA-256 digest modulo n, four digits at a time."""
    # cut once: inside a lambda the digest itself would be made anew for each of its parts
    digits = F.transform(F.regexp_extract_all(digest, F.lit(".{4}"), F.lit(0)), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 65536 + d) % n)


def bootstrap(values: DataFrame, by: list[str], draws: int, domain: str = "bootstrap") -> DataFrame:
    """by, draw, mean of draws with replacement, chosen by hashes: values (by, index from 0, value). Fewer than two values give none.

    Draws and values are merged, so that no side is gathered by the driver for a broadcast, however small it packs.
    """
    sizes = values.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    grid = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # by number, as AQE would put groups of a few bytes, whose draws are many rows, into one task
    grid = grid.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "draw").select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("position"))
    picked = grid.withColumn("index", hex_mod(F.sha2(F.concat_ws("|", F.lit(domain), *by, "draw", "position"), 256), F.col("n")))
    return picked.join(values.withColumn("index", F.col("index").cast("long")).hint("merge"), [*by, "index"]).groupBy(*by, "draw").agg(F.avg("value").alias("mean"))


def validity_gate(units: DataFrame, least_valid: int | None = None, least_per_cell: int | None = None, by: list[str] = (), most_missing: int = 3) -> DataFrame:
    """valid units in all, the fewest of a cell, and whether scores may be looked at; one row, or one for each group of `by`.

    units (by, cell_id, valid). Without `least_valid` all but `most_missing` units must be valid, and
    without `least_per_cell` all but one of each cell.
    """
    cells = units.groupBy(*by, "cell_id").agg(F.count_if("valid").alias("v"), F.count("*").alias("n"))
    whole = F.sum("v") >= (F.sum("n") - most_missing if least_valid is None else F.lit(least_valid))
    full = F.bool_and(F.col("v") >= F.col("n") - 1) if least_per_cell is None else F.min("v") >= least_per_cell
    return cells.groupBy(*by).agg(F.sum("v").alias("valid"), F.min("v").alias("fewest"), (whole & full).alias("execution_valid"))


COMPARATORS = ("withheld", "stale")


def family_effects(values: DataFrame, planned: int | None = None, threshold: float = 0.2, by: list[str] = ()) -> DataFrame:
    """by, family, observed and worst-case deltas to both comparators, and material_pass, of values (by, family, arm, score).

    In the worst case a missing draw of the correct arm scores 0 and one of a comparator 1. `planned`
    draws of each arm, or as many as it has rows: a row without a score is then a missing draw. An arm
    without scores has no deltas, and its family no pass.
    """
    sides = []
    for arm in ("correct", *COMPARATORS):
        own = F.when(F.col("arm") == arm, F.col("score"))
        n = F.count(F.when(F.col("arm") == arm, 1)) if planned is None else F.lit(planned)
        sides += [F.sum(own).alias(f"sum_{arm}"), F.count(own).alias(f"n_{arm}"), F.avg(own).alias(f"mean_{arm}"), n.alias(f"planned_{arm}")]
    out = values.groupBy(*by, "family").agg(*sides)
    enough = F.col("n_correct") == F.col("planned_correct")
    for arm in COMPARATORS:
        out = out.withColumn(f"observed_{arm}", F.col("mean_correct") - F.col(f"mean_{arm}"))
        most = F.col(f"sum_{arm}") + F.col(f"planned_{arm}") - F.col(f"n_{arm}")
        out = out.withColumn(f"worst_{arm}", F.try_divide("sum_correct", "planned_correct") - F.try_divide(most, F.col(f"planned_{arm}")))
    for name in (f"{kind}_{arm}" for kind in ("observed", "worst") for arm in COMPARATORS):
        enough = enough & (F.col(name) >= threshold - 1e-9)
    return out.select(*by, "family", *(f"{kind}_{arm}" for kind in ("observed", "worst") for arm in COMPARATORS), F.coalesce(enough, F.lit(False)).alias("material_pass"))


def verdict(families: DataFrame, by: list[str] = ()) -> DataFrame:
    """From families (by, passes, critical): how many pass, and what follows; one row, or one for each group of `by`."""
    n, stop = F.count_if("passes"), F.bool_or("critical")
    what = F.when(stop, "stop_or_redesign_once").when(n >= 2, "continue").when(n == 1, "narrow").otherwise("stop_or_redesign_once")
    return families.groupBy(*by).agg(n.alias("passing"), stop.alias("safety_stop"), what.alias("verdict"))
