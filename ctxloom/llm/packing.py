"""Bounded-space online packing of documents into sequences of fixed length.

Each partition keeps a fixed number of open windows. A document is cut into whole windows and one
rest; the rest goes to the open window that it fits best (the least room left over). If none fits
and no window is free, the fullest is emitted. What is still open at the end of a partition is
packed again with that of other partitions, in rounds over ever fewer partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import slices
from .encode import VOCABULARY, encoder

WINDOW = 1024
OPEN_WINDOWS = 64
#: Partitions whose leftovers meet in one task.
FAN_IN = 32

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, unit string, unit_at int, unit_length int, open boolean"


class OpenWindows:
    """At most `limit` open windows; place() returns those that it had to emit."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit = size, limit
        self.order: list[tuple[int, int]] = []  # (room, number), ascending
        self.content: dict[int, list] = {}
        self.number = 0

    def place(self, length: int, item) -> list[list]:
        if length == self.size:
            return [[(0, item)]]
        out = []
        i = bisect_left(self.order, (length, -1))
        if i < len(self.order):
            room, number = self.order.pop(i)
        else:
            if len(self.order) >= self.limit:
                out.append(self.content.pop(self.order.pop(0)[1]))
            room, number, self.number = self.size, self.number, self.number + 1
            self.content[number] = []
        self.content[number].append((self.size - room, item))
        if room > length:
            insort(self.order, (room - length, number))
        else:
            out.append(self.content.pop(number))
        return out

    def rest(self) -> list[list]:
        return [self.content[number] for _, number in self.order]


def _pieces(vocabulary: str, window: int, limit: int):
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, windows = encoder(vocabulary).ids, OpenWindows(window, limit)
        prefix, made = f"{TaskContext.get().partitionId()}", 0
        rows: list[tuple] = []

        def emit(items: list, still_open: bool) -> None:
            nonlocal made
            unit, total = f"{prefix}-{made}", sum(x[2] for _, x in items)
            made += 1
            rows.extend((*x, unit, at, total, still_open) for at, x in items)

        for frame in slices(frames, 1):
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                ids = encode(text.as_py())
                ids.append(0)
                total = len(ids)
                data = memoryview(ids).cast("B")
                for start in range(0, total, window):
                    length = min(window, total - start)
                    piece = (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), total)
                    for full in windows.place(length, piece):
                        emit(full, False)
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
        for items in windows.rest():
            emit(items, True)
        if rows:
            yield _frame(rows)

    return pack


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("unit", pa.string()), ("unit_at", pa.int32()), ("unit_length", pa.int32()), ("open", pa.bool_())])


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _merge(window: int, limit: int, level: int):
    """Places whole leftovers (unit, length); says where each went and whether that is still open."""

    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows, made = OpenWindows(window, limit), 0
        prefix = f"{level}.{TaskContext.get().partitionId()}"
        out: list[tuple] = []

        def emit(items: list, still_open: bool) -> None:
            nonlocal made
            target, total = f"{prefix}-{made}", sum(length for _, (_, length) in items)
            made += 1
            out.extend((unit, target, at, total, still_open) for at, (unit, length) in items)

        for frame in frames:
            for unit, length in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                for full in windows.place(length, (unit, length)):
                    emit(full, False)
        for items in windows.rest():
            emit(items, True)
        if out:
            names = ["unit", "target", "target_at", "target_length", "target_open"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return merge


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of a document: where its ids start, and its place in a sequence.

    Reads doc_id and text only. Null text is empty; an empty document is its closing id 0 alone.
    Repeated rows are packed each for itself. An empty table gives no piece. The pieces (without
    ids) are written once in the shared folder, so that texts are encoded once and a lost executor
    costs only its own tasks.
    """
    pieces = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, window, open_windows), PIECES), "pieces")
    partitions = pieces.select(F.substring_index("unit", "-", 1)).distinct().count()
    level, moves = 0, []
    left = pieces.where("open and unit_at = 0").select("unit", "unit_length")
    while partitions > 1:
        partitions, level = -(-partitions // FAN_IN), level + 1
        dealt = left.repartition(partitions, F.xxhash64("unit")) if partitions > 1 else left.coalesce(1)
        moved = materialise(dealt.sortWithinPartitions(F.desc("unit_length"), "unit").mapInArrow(_merge(window, open_windows, level), "unit string, target string, target_at int, target_length int, target_open boolean"), "leftovers")
        moves.append(moved)
        left = moved.where("target_open and target_at = 0").select(F.col("target").alias("unit"), F.col("target_length").alias("unit_length"))
    out = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", "unit_at")
    if moves:
        final = moves[0].select("unit", "target", "target_at")
        for moved in moves[1:]:
            step = moved.select(F.col("unit").alias("target"), F.col("target").alias("next"), F.col("target_at").alias("more"))
            final = final.join(step, "target", "left").select("unit", F.coalesce("next", "target").alias("target"), (F.col("target_at") + F.coalesce("more", F.lit(0))).alias("target_at"))
        out = out.join(final, "unit", "left").withColumn("unit_at", F.col("unit_at") + F.coalesce("target_at", F.lit(0))).withColumn("unit", F.coalesce("target", "unit"))
    return out.select("doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", _sequence_id(F.col("unit")).alias("sequence_id"), F.col("unit_at").cast("long").alias("offset"))


def _sequence_id(unit):
    """level.partition-number as one long: 4 bits, 24 bits, 35 bits."""
    head, number = F.substring_index(unit, "-", 1), F.substring_index(unit, "-", -1).cast("long")
    level = F.when(F.contains(head, F.lit(".")), F.substring_index(head, ".", 1).cast("long")).otherwise(0)
    return F.shiftleft(level, 59) + F.shiftleft(F.substring_index(head, ".", -1).cast("long"), 35) + number
