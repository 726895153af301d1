"""Exact tests and intervals of small groups.

A group's values meet in one row, many groups in a task, and what has to be enumerated is counted by
distinct sums in that task: one shuffle of the values, however many draws a group has. Groups are
small by nature, and a larger one than the counts can hold is an error before any meets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate
from math import ceil, comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts of ways, and the most rows of a group whose counts they hold: n^n resamples, C(n, n/2) choices.
WAYS, MOST_RESAMPLED, MOST_PERMUTED = "decimal(38,0)", 26, 120
#: The middle 95 percent.
LOW, HIGH = 0.025, 0.975


def bounded(values: DataFrame, by: Sequence[str], most: int, what: str) -> None:
    """An error where a group has more rows than `most`."""
    largest = values.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise OverflowError(f"a group of {largest} rows has more {what} than 38 digits count; at most {most} rows")


def each(groups: DataFrame, by: Sequence[str], schema: str, compute: Callable[..., list[tuple]]) -> DataFrame:
    """by and the columns of `schema`: the rows that compute(the other columns of a group) gives."""
    out = groups.select(*by).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out]
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"double": pa.float64(), "long": pa.int64(), WAYS: pa.decimal128(38, 0)}
    arrow = [types[part.split()[1]] for part in schema.split(", ")]

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rest = [frame.column(i).to_pylist() for i in range(len(by), frame.num_columns)]
            found = [compute(*row) for row in zip(*rest, strict=True)]
            which = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            rows = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(frame.column(i).take(which) for i in range(len(by))), *(pa.array(list(x), t) for x, t in zip(rows, arrow, strict=True))], names=[*by, *names])

    return groups.mapInArrow(fold, ", ".join([*kinds, schema]))


def choices(treated: Sequence[int], others: Sequence[int]) -> tuple[int, int]:
    """(ways at least as extreme, all ways) to choose as many values as are treated; equal sums are extreme."""
    k, ways = len(treated), [{} for _ in range(len(treated) + 1)]
    ways[0][0] = 1
    for value in (*treated, *others):
        for taken in range(k - 1, -1, -1):
            more = ways[taken + 1]
            for total, n in ways[taken].items():
                more[total + value] = more.get(total + value, 0) + n
    seen = sum(treated)
    return sum(n for total, n in ways[k].items() if total >= seen), comb(k + len(others), k)


def completed(scores: Sequence[int], planned: int, missing: int) -> list[int]:
    """A group's scores with what is missing of the planned ones set to an end of the scale."""
    if len(scores) > planned:
        raise ValueError(f"{len(scores)} scores of {planned} planned ones")
    return [*scores, *[missing] * (planned - len(scores))]


def sums(values: Sequence[int]) -> dict[int, int]:
    """How many of the n^n resamples of n values have each sum."""
    now = {0: 1}
    times = {value: values.count(value) for value in values}
    for _ in values:
        new: dict[int, int] = {}
        for total, n in now.items():
            for value, k in times.items():
                new[total + value] = new.get(total + value, 0) + n * k
        now = new
    return now


def interval(left: Sequence[int], right: Sequence[int], ends: Sequence[float] = (LOW, HIGH)) -> list[float]:
    """Nearest-rank percentiles of mean(left) - mean(right) over all pairs of resamples.

    The pairs aren't listed: for a bound on the difference the pairs below it are counted from the
    sorted sums of both sides, and the least bound with enough of them is found by halving.
    """
    # on a whole-number scale, so that equal differences are one value
    a = sorted((total * len(right), n) for total, n in sums(left).items())
    b = sorted((total * len(left), n) for total, n in sums(right).items())
    places, below = [x for x, _ in b], [0, *accumulate(n for _, n in b)]
    every = sum(n for _, n in a) * below[-1]

    def up_to(bound: int) -> int:
        return sum(n * (below[-1] - below[bisect_left(places, x - bound)]) for x, n in a)

    out = []
    for p in ends:
        need = max(1, ceil(Fraction(str(p)) * every))
        low, high = a[0][0] - places[-1], a[-1][0] - places[0]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if up_to(middle) >= need else (middle + 1, high)
        out.append(low / (len(left) * len(right)))
    return out


def _sides(values: DataFrame, by: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    score = F.col("score").cast("long")
    return values.groupBy(*by).agg(F.collect_list(F.when(F.col("treated"), score)).alias("treated"), F.collect_list(F.when(~F.col("treated"), score)).alias("others"), *more)


def permutation_p(values: DataFrame, by: list[str]) -> DataFrame:
    """by, p, combinations: exact one-sided p of a difference of means for groups (by, treated, score as an integer); ties are extreme.

    A group of more than 120 rows is an error: its counts can have more than 38 digits. A side
    without rows leaves one choice, whose p is 1.
    """
    bounded(values, by, MOST_PERMUTED, "choices")

    def compute(treated: list[int], others: list[int]) -> list[tuple]:
        extreme, every = choices(treated, others)
        return [(extreme / every, Decimal(every))]

    return each(_sides(values, by), by, f"p double, combinations {WAYS}", compute)


def completed_p(values: DataFrame, by: list[str], planned: DataFrame, top: int) -> DataFrame:
    """by, observed_p, p: the exact p of what is there, and its supremum over all scores from 0 to `top` that missing rows may have.

    values (by, treated, score as an integer in [0, top]), planned (by, treated, planned). The supremum is
    reached at an end of the scale: a missing treated row has 0 and a missing other one `top`, as
    raising an other or lowering a treated score can only make more choices extreme. A group that
    is planned but has no values is completed too; a side that has none has no observed_p. More values
    than planned, or a score outside the scale, are an error.
    """
    bounded(planned.select(*by, F.explode(F.sequence(F.lit(1), F.col("planned").cast("int")))), by, MOST_PERMUTED, "choices")
    zero = F.lit(0).cast("long")
    number = F.col("planned").cast("long")
    rows = values.select(*by, "treated", "score", zero.alias("planned")).unionByName(planned.select(*by, "treated", F.lit(None).cast("long").alias("score"), number.alias("planned")))
    groups = _sides(rows, by, [F.sum(F.when(F.col("treated"), F.col("planned")).otherwise(zero)).alias("n_treated"), F.sum(F.when(F.col("treated"), zero).otherwise(F.col("planned"))).alias("n_others")])

    def compute(treated: list[int], others: list[int], n_treated: int, n_others: int) -> list[tuple]:
        return [completed_choice(treated, others, n_treated, n_others, top)]

    return each(groups, by, "observed_p double, p double", compute)


def completed_choice(treated: Sequence[int], others: Sequence[int], n_treated: int, n_others: int, top: int) -> tuple[float | None, float]:
    if any(not 0 <= x <= top for x in (*treated, *others)):
        raise ValueError(f"a score outside 0 to {top}")
    extreme, every = choices(treated, others)
    worst, all_ways = choices(completed(treated, n_treated, 0), completed(others, n_others, top))
    return extreme / every if treated and others else None, worst / all_ways


#: Pairs of score lists whose figures a Python worker keeps.
KEPT = 1 << 16


@lru_cache(KEPT)
def _compared(treated: tuple[int, ...], others: tuple[int, ...], n_treated: int, n_others: int, top: int) -> tuple:
    ends = interval(treated, others) if treated and others else [None, None]
    return (*completed_choice(treated, others, n_treated, n_others, top), *ends)


def compared(treated: Sequence[int], others: Sequence[int], n_treated: int, n_others: int, top: int) -> tuple:
    """observed_p, p, low, high of two arms: completed_choice() and interval().

    They follow from how often each score occurs, so groups with the same scores are computed once a worker.
    """
    return _compared(tuple(sorted(treated)), tuple(sorted(others)), n_treated, n_others, top)


def resampled_means(values: DataFrame, by: list[str]) -> DataFrame:
    """Histogram of the sums of all n^n resamples of each group (by, value): by, n, total, ways.

    Rows grow with distinct sums and not with n^n. ways has 38 digits; a group of more than
    MOST_RESAMPLED rows has more ways than that and is an error.
    """
    bounded(values, by, MOST_RESAMPLED, "resamples")
    groups = values.groupBy(*by).agg(F.collect_list(F.col("value").cast("long")).alias("values"))
    return each(groups, by, f"n long, total long, ways {WAYS}", lambda own: [(len(own), total, Decimal(n)) for total, n in sums(own).items()])


def resampled_interval(left: DataFrame, right: DataFrame, by: list[str], low: float = LOW, high: float = HIGH) -> DataFrame:
    """by, low, high: percentiles of the difference of means (left - right) over all pairs of resamples of both groups.

    left and right are values (by, value as an integer). A group without rows on one side gives none.
    """
    both = left.select(*by, F.lit(True).alias("treated"), F.col("value").alias("score")).unionByName(right.select(*by, F.lit(False).alias("treated"), F.col("value").alias("score")))
    bounded(both, [*by, "treated"], MOST_RESAMPLED, "resamples")

    def compute(treated: list[int], others: list[int]) -> list[tuple]:
        return [tuple(interval(treated, others, (low, high)))] if treated and others else []

    return each(_sides(both, by), by, "low double, high double", compute)
