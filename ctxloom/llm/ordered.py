"""Runs of equal neighbours in sorted tables, and running figures, where no task holds a whole group.

A table is dealt by ranges of its order, so a group of any size spans as many partitions as it
fills. Each partition is read once as a stream; what crosses from one partition to the next is
settled on one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

#: The column by which neighbours are compared.
KEY = "_key"
#: So many places of a group's order are summed up in one task.
SPAN = 4096


def runs(rows: DataFrame, ranges: Sequence[str | Column], order: Sequence[str | Column], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows sorted by `order` and numbered, equal neighbours in KEY being one group.

    rows: their columns without KEY, `part`, `run` (in the part) and `pos` (from 0 in the run), written to the
    shared folder. groups: for each run its rows `n`, the first part and run of its group
    (`head_part`, `head_run`) and the rows of the group `before` it. `ranges` deals the rows by sampled
    splitters and must agree with `order` but for columns that are equal where KEY is; its columns
    should be short, as samples of them pass the driver. KEY must not be null.
    """
    dealt = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    rest, kind = [c for c in rows.columns if c != KEY], dict(rows.dtypes)[KEY]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != KEY)
    schema = f"{fields}, part int, run long, pos long, first_key {kind}, last_key {kind}"
    at = rows.columns.index(KEY)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, pos, first, last, like = TaskContext.get().partitionId(), -1, 0, None, None, None
        for frame in frames:
            n, keys = len(frame), frame.column(at)
            if not n:
                continue
            starts = np.ones(n, bool)
            starts[1:] = ~np.asarray(pc.equal(keys.slice(1), keys.slice(0, n - 1)))
            if last is not None:
                starts[0] = keys[0] != last
            else:
                first = keys[0]
            number = run + np.cumsum(starts)
            begins = np.flatnonzero(starts)
            place = np.arange(n)
            held = number > run  # rows of runs that begin here
            place[held] -= begins[number[held] - run - 1]
            place[~held] += pos
            run, pos, last = int(number[-1]), int(place[-1]) + 1, keys[n - 1]
            like = frame.schema
            others = [frame.column(c) for c in rest]
            none = pa.nulls(n, keys.type)
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.full(n, part), pa.int32()), pa.array(number, pa.int64()), pa.array(place, pa.int64()), none, none], names=names)
        if last is not None:
            edge = [pa.nulls(1, like.field(c).type) for c in rest]
            ends = [pa.array([part], pa.int32()), pa.array([run + 1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([first.as_py()], first.type), pa.array([last.as_py()], last.type)]
            yield pa.RecordBatch.from_arrays([*edge, *ends], names=names)

    names = [*rest, "part", "run", "pos", "first_key", "last_key"]
    folded = materialise(dealt.mapInArrow(fold, schema), name)
    numbered = folded.where("pos is not null").select(*rest, "part", "run", "pos")
    sizes = numbered.groupBy("part", "run").agg(F.count("*").alias("n"))
    groups = sizes.join(_heads(folded.where("pos is null").select("part", F.col("run").alias("runs"), "first_key", "last_key")), "part")
    ours = (F.col("run") == 0) & F.col("joined")
    groups = groups.select("part", "run", "n", F.when(ours, F.col("head.part")).otherwise(F.col("part")).alias("head_part"), F.when(ours, F.col("head.run")).otherwise(F.col("run")).alias("head_run"))
    ahead = Window.partitionBy("head_part", "head_run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return numbered, groups.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def _heads(edges: DataFrame) -> DataFrame:
    """part, joined (its first run goes on from the part before), head (where that group begins); one row a partition."""
    order = Window.orderBy("part")
    placed = edges.withColumn("at", F.row_number().over(order))
    before = placed.select((F.col("at") + 1).alias("at"), F.col("last_key").alias("key_before"))
    both = placed.join(before, "at", "left").select("part", "runs", F.coalesce(F.col("first_key") == F.col("key_before"), F.lit(False)).alias("joined"))
    # a part of one run that itself goes on begins no group
    begins = F.when(~F.col("joined") | (F.col("runs") > 1), F.struct("part", (F.col("runs") - 1).alias("run")))
    return both.select("part", "joined", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("head"))


def ahead_of(rows: DataFrame, by: Sequence[str], order: str, values: dict[str, tuple[str, str]], span: int = SPAN) -> DataFrame:
    """rows with running figures over the rows ahead of each in its group: values maps a new name to (column, 'sum' or 'xor').

    `order` is a whole number, distinct in a group. Figures run inside spans of it, and those of whole
    spans are added, so that a task holds a span of a group.
    """
    figures = {"sum": (F.sum, Column.__add__), "xor": (F.bit_xor, Column.bitwiseXOR)}
    zero = F.lit(0).cast("long")
    dealt = rows.withColumn("_span", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    for name, (column, what) in values.items():
        dealt = dealt.withColumn(name, F.coalesce(figures[what][0](column).over(inside), zero))
    spans = rows.groupBy(*by, F.floor(F.col(order) / span).alias("_span")).agg(*[figures[what][0](column).alias(f"_{name}") for name, (column, what) in values.items()])
    spans = spans.select(*by, "_span", *[F.coalesce(figures[what][0](f"_{name}").over(across), zero).alias(f"_{name}") for name, (_, what) in values.items()])
    out = dealt.join(spans, [*by, "_span"])
    sums = {name: figures[what][1](F.col(name), F.col(f"_{name}")) for name, (_, what) in values.items()}
    return reduce(lambda df, item: df.withColumn(*item), sums.items(), out).drop("_span", *[f"_{name}" for name in values])
