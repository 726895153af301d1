"""Ranking of candidates and packing them into a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from inspect import signature

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

WEIGHTS = {"relevance": 0.70, "importance": 0.25, "recency": 0.05}
TRUNCATE_ROOM = 50


def score(relevance: Column, importance: Column, recency: Column, has_query: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """With a query the weighted mean, importance held in [0, 1]; without one the importance itself."""
    total = sum(weights.values())
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), importance))
    mixed = (relevance * weights["relevance"] + held * weights["importance"] + recency * weights["recency"]) / total
    return F.when(has_query, mixed).otherwise(importance)


def rank(df: DataFrame, by: list[str] = ("query_id",), score: str = "score", tie: str = "seq") -> DataFrame:
    """rank from 1; equal scores keep their input order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def top_k(df: DataFrame, k: int, by: list[str] = ("query_id",), score: str = "score", tie: str = "seq") -> DataFrame:
    return rank(df, by, score, tie).where(F.col("rank") <= k)


def numbered(df: DataFrame, by: str, order: str, name: str, span: int = 4096) -> DataFrame:
    """Numbers from 0 in each group, by a whole number that orders it, however large a group is. Rows equal in `order` may swap their numbers."""
    return numbered_in_spans(df, [by], [order], F.floor(F.col(order) / span), name)


def numbered_in_spans(df: DataFrame, by: list[str], order: list[str], span: Column, name: str) -> DataFrame:
    """Numbers from 0 in each group, or in all rows; `span` must not fall where `order` rises.

    Two steps: rows are numbered inside spans of the order, and the spans' sizes are summed ahead of
    them, so that a task holds a span and not a group.
    """
    dealt = df.withColumn("_span", span)
    groups = {f"_by{i}": c for i, c in enumerate(by)}
    sizes = dealt.groupBy(*[F.col(c).alias(g) for g, c in groups.items()], F.col("_span").alias("_s")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*groups).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_s", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_span").orderBy(*order)) - 1)
    same = inside["_span"].eqNullSafe(starts["_s"])
    for g, c in groups.items():
        same = same & inside[c].eqNullSafe(starts[g])
    return inside.join(starts, same).withColumn(name, F.col("_start") + F.col("_i")).drop("_span", "_s", "_start", "_i", *groups)


def spans(df: DataFrame, order: list[str], n: int = 256) -> Column:
    """A column that cuts the order of all rows into some n spans of about equal size: how many of n - 1 rows, drawn by hash, come first."""
    drawn = df.select(*order).orderBy(F.xxhash64(*order)).limit(n - 1).collect()
    if not drawn:
        return F.lit(0)
    marks = F.array(*[F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order]) for row in drawn])
    return F.size(F.filter(marks, lambda mark: mark <= F.struct(*order)))


def pool_rank(df: DataFrame, by: list[str], value: str, name: str = "normalised") -> DataFrame:
    """Dense ranks of a pool on [0, 1]; one distinct value is 0.5.

    Distinct values are ranked, and rows join theirs, so that a large pool isn't one task. Rows
    without a value rank below all others.
    """
    pool = Window.partitionBy(*by)
    distinct = df.select(*by, value).distinct().withColumn("_d", F.dense_rank().over(pool.orderBy(value)))
    most = F.max("_d").over(pool)
    places = distinct.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(value).alias("_value"), F.when(most == 1, 0.5).otherwise((F.col("_d") - 1) / (most - 1)).alias(name))
    same = df[value].eqNullSafe(places["_value"])
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(places[f"_by{i}"])
    return df.join(places, same).drop("_value", *[f"_by{i}" for i in range(len(by))])


def prefix_pack(df: DataFrame, budget: Column, tokens: str = "tokens", by: list[str] = ("query_id",), room: int = TRUNCATE_ROOM) -> DataFrame:
    """Take by rank while the sum fits; the first that doesn't is cut to what is left if that is over `room`; then stop."""
    order = Window.partitionBy(*by).orderBy("rank")
    sums = df.withColumn("_sum", F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_sum") - F.col(tokens))
    sums = sums.withColumn("_misses", F.sum(F.when(F.col("_sum") > budget, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = budget - F.col("_before")
    taken = F.when(F.col("_misses") == 0, F.col(tokens)).when((F.col("_misses") == 1) & (F.col("_sum") > budget) & (left > room), left)
    return sums.withColumn("taken", taken).where("taken is not null").drop("_sum", "_before", "_misses")


def pack(ranked: DataFrame, *, max_components: int | None = None, redundancy: float | None = None, summarize: Callable[..., str] | None = None, count: Callable[[str], int] | None = None, only_included: bool = False, contents: DataFrame | None = None) -> DataFrame:
    """One decision per row of (query_id, id, rank, tokens, token_budget, relevance, min_relevance, required_miss): query_id, id, rank, included, reason, tokens, summary.

    Packing by tokens alone goes by spans of the ranks (_packed_by_spans), so that no task holds a
    query's rows. With `summarize` a row's fate depends on the contents of those before it: a round folds
    the first rows of each query, until its budget is spent, and the next round eight times as many. With
    `redundancy` the rows of a query are read as a stream by rank in one task, which holds the state of
    one query only. `terms` are read with `redundancy`, `content` (or `contents`: id, content) and `query` with `summarize`, by rows alone that are not decided before any state, and `summary` is set where a
    summary was included. query_id must not be null. A row that doesn't fit doesn't stop later, smaller ones. Rows that miss a
    required term or have too little relevance are decided before any state. summarize(content,
    room) or summarize(content, room, query) is cut to its room in words; with `count` it is counted
    by that and not cut. A row without a number of tokens, or whose summary can't be made or counted, is left
    out as a processing_error of 0 tokens and spends nothing. With `only_included` other rows give no decision.
    """
    early = F.when(F.col("tokens").isNull(), "processing_error").when(F.col("required_miss"), "required_term_miss").when(F.col("relevance") < F.col("min_relevance"), "below_relevance_threshold")
    asks = summarize is not None and len(signature(summarize).parameters) > 2

    def shorter(content: str, room: int, query: str | None) -> tuple[str, int]:
        made = summarize(content, room, query) if asks else summarize(content, room)
        if count is None:
            made = " ".join(made.split()[:room])
        return made, len(made.split()) if count is None else count(made)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, chosen, sets = None, 0, 0, []
        for frame in frames:
            open_ = frame.column("early").is_null()
            live = frame.filter(open_)
            column = dict(zip(live.schema.names, (c.to_pylist() for c in live.columns), strict=True))
            reasons, sizes, summaries, spent, taken = [], [], [], [], []
            for i, (query, tokens, budget, reason) in enumerate(zip(column["query_id"], column["tokens"], column["token_budget"], column["early"], strict=True)):
                if query != now:
                    now, used, chosen, sets = query, column["used"][i], column["chosen"][i], []
                summary, own = None, ()
                if reason is None:
                    left = None if budget is None else budget - used
                    own = set(column["terms"][i]) if redundancy is not None else ()
                    if redundancy is not None and any(_jaccard(own, x) >= redundancy for x in sets):
                        reason = "redundant"
                    elif max_components is not None and chosen >= max_components:
                        reason = "max_components"
                    elif left is not None and tokens > left:
                        if left <= 0:
                            reason = "budget_exhausted"
                        elif summarize is None:
                            reason = "over_budget"
                        else:
                            try:
                                summary, tokens = shorter(column["content"][i], left, column["query"][i] if asks else None)
                                reason = "included_summarized" if summary and tokens <= left else "summarization_failed_budget"
                            except Exception:  # whatever a caller's function raises is this row's error alone
                                summary, tokens, reason = None, 0, "processing_error"
                    else:
                        reason = "included"
                    if reason.startswith("included"):
                        used, chosen = used + tokens, chosen + 1
                        sets.append(own)
                reasons.append(reason)
                sizes.append(tokens)
                summaries.append(summary if reason == "included_summarized" else None)
                spent.append(used)
                taken.append(chosen)
            nothing = (pa.array([False] * len(frame)), frame.column("early"), frame.column("tokens"), pa.nulls(len(frame), pa.string()), frame.column("used"), frame.column("chosen"))
            found = (pa.array([x.startswith("included") for x in reasons], pa.bool_()), pa.array(reasons, pa.string()), pa.array(sizes, pa.int32()), pa.array(summaries, pa.string()), pa.array(spent, pa.int64()), pa.array(taken, pa.int64()))
            decided = [pc.replace_with_mask(before, open_, after) for before, after in zip(nothing, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], *decided], names=["query_id", "id", "rank", "included", "reason", "tokens", "summary", "used", "chosen"])

    if redundancy is None and summarize is None:
        return _packed_by_spans(ranked.select("query_id", "id", F.col("rank").cast("int"), F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens"), "token_budget", early.alias("early")), max_components, only_included)
    zero = F.lit(0).cast("long")
    held = summarize is not None and (redundancy is not None or contents is None)
    more = ["terms"] * (redundancy is not None) + ["content"] * held + ["query"] * asks
    rows = ranked.select("query_id", "id", F.col("rank").cast("int"), F.coalesce("tokens", F.lit(0)).cast("int").alias("tokens"), "token_budget", early.alias("early"), *[F.when(early.isNull(), F.col(c)).alias(c) for c in more], zero.alias("used"), zero.alias("chosen"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = f"query_id {kinds['query_id']}, id {kinds['id']}, rank int, included boolean, reason string, tokens int, summary string, used long, chosen long"

    def folded(some: DataFrame) -> DataFrame:
        return some.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(fold, packed)

    out = folded(rows) if redundancy is not None else _packed_in_rounds(rows, max_components, folded, contents)
    out = out.drop("used", "chosen")
    return out.where("included") if only_included else out


#: Rows of a query that are folded in the first round of those whose contents are read, and how many times as many the next round takes.
FIRST_ROUND, GROWTH = 64, 8


def _packed_in_rounds(rows: DataFrame, max_components: int | None, folded: Callable[[DataFrame], DataFrame], contents: DataFrame | None) -> DataFrame:
    """pack() with summaries: rows that stand behind the end of their query's budget, or numbers of rows, are decided without their contents."""
    rows = materialise(rows, "ranked")
    names = ["query_id", "id", "rank", "included", "reason", "tokens", "summary", "used", "chosen"]

    def decided(some: DataFrame, reason: Column) -> DataFrame:
        return some.withColumn("reason", reason).withColumn("included", F.col("reason") == "included").withColumn("summary", F.lit(None).cast("string")).select(names)

    # without a budget or a number of rows all are included
    free = F.col("token_budget").isNull() if max_components is None else F.lit(False)
    steps = [decided(rows.where(F.col("early").isNotNull() | free), F.coalesce("early", F.lit("included")))]
    waiting, size = rows.where(F.col("early").isNull() & ~free), FIRST_ROUND
    left = F.col("token_budget") - F.col("used")
    full = F.lit(False) if max_components is None else F.col("chosen") >= max_components
    spent = F.coalesce(left < 0 if max_components is not None else left <= 0, F.lit(False))
    while True:
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        taken = waiting.withColumn("_n", first).where(F.col("_n") <= size).drop("_n")
        step = materialise(folded(taken if contents is None else taken.join(contents, "id", "left").select(*rows.columns, "content")), "packed")
        last = step.groupBy("query_id").agg(F.max("rank").alias("_last"), F.max_by("used", "rank").alias("used"), F.max_by("chosen", "rank").alias("chosen"))
        rest = waiting.drop("used", "chosen").join(last, "query_id").where(F.col("rank") > F.col("_last"))
        steps += [step, decided(rest.where(full | spent), F.when(full, "max_components").when(F.col("tokens") > left, "budget_exhausted").otherwise("included"))]
        waiting, size = materialise(rest.where(~(full | spent)).select(rows.columns), "waiting"), size * GROWTH
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, steps)


#: Rows of a query that are folded in one round; Spark limits a window of so many before its shuffle.
ROUND = 1000


def _packed_by_spans(rows: DataFrame, max_components: int | None, only_included: bool) -> DataFrame:
    """pack() by tokens and numbers of rows alone.

    What is left of a budget only shrinks, so a row that is larger than it once is left out for good.
    A round folds the first ROUND rows of each query that may still fit; what is left then rules out
    the rest of the ranks but for rows that are small enough, which the next round takes. Every round
    includes a row of each query that is still open, and one or two settle most. Why a row was left out
    follows from two ranks of its query: where its budget was spent, and where it had all its rows.
    """
    rows = materialise(rows, "ranked")
    budget = F.col("token_budget")
    live = rows.where("early is null")
    # a row that takes nothing from a budget is included, wherever it stands, if rows aren't counted
    free = budget.isNull() | ((F.col("tokens") <= 0) & (budget >= F.col("tokens"))) if max_components is None else F.lit(False)
    fits = (F.col("used") + F.col("tokens") <= budget) | budget.isNull()
    if max_components is not None:
        fits &= F.col("chosen") < max_components
    kind, kind_of_id = (dict(rows.dtypes)[c] for c in ("query_id", "id"))

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for frame in frames:
            out = []
            column = [frame.column(c).to_pylist() for c in ("query_id", "rank", "tokens", "token_budget", "used", "chosen", "id")]
            for query, rank_, tokens, most, used, chosen, id_ in zip(*column, strict=True):
                if state is None or state[0] != query:
                    if state:
                        out.append((*state, False, None, None))
                    state = [query, rank_, used, chosen]
                state[1] = rank_
                if (most is None or state[2] + tokens <= most) and (max_components is None or state[3] < max_components):
                    state[2], state[3] = state[2] + tokens, state[3] + 1
                    out.append((*state, True, id_, tokens))
            types = [frame.schema.field(c).type for c in ("query_id", "id")]
            yield batch(out, *types)
        if state:
            yield batch([(*state, False, None, None)], *types)

    def batch(out: list[tuple], of: pa.DataType, of_id: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (of, pa.int32(), pa.int64(), pa.int64(), pa.bool_(), of_id, pa.int32()), strict=True)], names=["query_id", "rank", "used", "chosen", "included", "id", "tokens"])

    zero = F.lit(0).cast("long")
    waiting = live.where(~F.coalesce(free, F.lit(False))).select("query_id", "id", "rank", "tokens", "token_budget", zero.alias("used"), zero.alias("chosen")).where(fits)
    steps = []
    while True:
        first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        taken = waiting.withColumn("_n", first).where(F.col("_n") <= ROUND).drop("_n")
        step = materialise(taken.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(fold, f"query_id {kind}, rank int, used long, chosen long, included boolean, id {kind_of_id}, tokens int"), "packed")
        steps.append(step.where("included"))
        now = step.where("not included").select("query_id", F.col("rank").alias("_last"), "used", "chosen")
        waiting = materialise(waiting.drop("used", "chosen").join(now, "query_id").where((F.col("rank") > F.col("_last")) & fits).drop("_last"), "waiting")
        if waiting.isEmpty():
            break
    included = reduce(DataFrame.unionByName, steps)
    decision = [F.lit("included").alias("reason"), "tokens", F.lit(None).cast("string").alias("summary")]
    if only_included:
        every = included.select("query_id", "id", "rank", "tokens").unionByName(live.where(free).select("query_id", "id", "rank", "tokens"))
        return every.select("query_id", "id", "rank", F.lit(True).alias("included"), *decision)
    most = live.select("query_id", "token_budget").where(budget <= 0).distinct().select("query_id", F.lit(0).alias("_spent"), F.lit(None).cast("int").alias("_full"))
    ends = included.join(live.select("query_id", "rank", "token_budget"), ["query_id", "rank"]).select("query_id", F.when(F.col("used") >= budget, F.col("rank")).alias("_spent"), F.when(F.col("chosen") >= (F.lit(None) if max_components is None else F.lit(max_components)), F.col("rank")).alias("_full"))
    ends = ends.unionByName(most).groupBy("query_id").agg(F.min("_spent").alias("_spent"), F.min("_full").alias("_full"))
    if max_components is not None and max_components <= 0:
        ends = ends.withColumn("_full", F.lit(0))
    # read from a table, so that both sides of the join are shuffled for it and AQE can split a query
    ends = materialise(ends, "ends")
    chosen = included.select("query_id", "rank", F.lit(True).alias("_in"))
    both = rows.join(chosen, ["query_id", "rank"], "left").join(ends, "query_id", "left")
    full = F.lit(False) if max_components is None else F.lit(max_components <= 0) | F.coalesce(F.col("rank") > F.col("_full"), F.lit(False))
    here = F.coalesce(F.col("_in") | free, F.lit(False))
    reason = F.when(here, "included").when(full, "max_components").when(F.col("rank") > F.col("_spent"), "budget_exhausted").otherwise("over_budget")
    return both.select("query_id", "id", "rank", (F.col("early").isNull() & here).alias("included"), F.coalesce("early", reason).alias("reason"), "tokens", F.lit(None).cast("string").alias("summary"))


def with_content(decisions: DataFrame, contents: DataFrame) -> DataFrame:
    """Decisions with the content, or its summary, of what is included; contents (id, content) join for those rows alone."""
    chosen = decisions.where("included and summary is null").select("query_id", "id").join(contents.select("id", "content"), "id")
    return decisions.join(chosen, ["query_id", "id"], "left").withColumn("content", F.coalesce("summary", "content")).drop("summary")


def _jaccard(a: set, b: set) -> float:
    union = len(a | b)
    return len(a & b) / union if union else 0.0
