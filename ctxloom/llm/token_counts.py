"""Token counts from flat token files, by a separator scan.

A token file is a flat run of fixed-width ids without an index; every document ends with one
end-of-document id. Files are read in blocks that ignore document boundaries. Each block is
searched by one vectorised comparison; a prefix scan over the blocks' totals then gives every
block the tokens and documents before it and the place of the last separator before it, which is
all that is needed to stitch documents that cross blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import slices
from .encode import END_OF_DOCUMENT, VOCABULARY, encoder

BLOCK_BYTES = 1 << 20
#: Blocks that are summed in one step of the scan before their totals are.
SPAN = 1024

BLOCKS = "file string, block long, data binary, names array<long>"


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode doc_id and text into flat files of 16-bit ids, one a partition, kept as blocks.

    `names` holds the doc_ids whose separator is written in a block, in the order of the file; it
    says nothing of places. Null text is empty. Reads only doc_id and text.
    """

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, file = encoder(vocabulary).ids, f"part-{TaskContext.get().partitionId():06d}"
        buffer, names, block = bytearray(), [], 0

        def out(data: bytes, upto: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([upto], pa.list_(pa.int64()))], names=["file", "block", "data", "names"])

        for frame in slices(frames, 1):
            for doc_id, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                buffer += np.frombuffer(ids_of(text.as_py()), np.uint32).astype("<u2").tobytes()
                buffer += end.to_bytes(2, "little")
                while len(buffer) > block_bytes:  # the separator, and so the name, is in a later block
                    yield out(bytes(buffer[:block_bytes]), names)
                    del buffer[:block_bytes]
                    names, block = [], block + 1
                names.append(doc_id)
        if buffer:
            yield out(bytes(buffer), names)

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, BLOCKS), "tokens")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, blocks_per_row: int = 64) -> DataFrame:
    """Blocks of real flat files, of any size: Spark lists the files, and tasks read ranges of their bytes.

    The ranges are read by pyarrow.fs, so the paths must be of a store that it knows (file, hdfs, s3,
    gs, abfs). An empty file has no block.
    """
    step = block_bytes * blocks_per_row
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    spans = files.select("file", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("span")).repartition("file", "span")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for frame in frames:
            for file, span in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                with store.open_input_file(place) as source:
                    for block in range(span * blocks_per_row, (span + 1) * blocks_per_row):
                        if block * block_bytes >= source.size():
                            break
                        data = source.read_at(block_bytes, block * block_bytes)
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "names"])

    return spans.mapInArrow(read, BLOCKS)


def separator_scan(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """One row per document of each file: file, ordinal, start (in tokens), n_tokens, closed.

    n_tokens leaves the separator out. Tokens after the last separator of a file are a document
    that isn't closed. Blocks must be whole in tokens. An empty table gives no row.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ends = [np.flatnonzero(np.frombuffer(x.as_buffer(), kind) == end).astype(np.int32) for x in frame.column(2)]
            tokens = [x.as_buffer().size // width for x in frame.column(2)]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["file", "block", "tokens", "ends"])

    found = materialise(blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, tokens long, ends array<int>"), "separators")
    placed = block_starts(found.select("file", "block", "tokens", F.size("ends").cast("long").alias("docs"), F.try_element_at("ends", F.lit(-1)).cast("long").alias("last")))
    ends = found.select("file", "block", F.posexplode("ends").alias("at", "end"), F.when(F.col("at") > 0, F.try_element_at("ends", F.greatest(F.col("at"), F.lit(1)))).alias("before"))
    joined = ends.join(placed.select("file", "block", "tokens_before", "docs_before", "last_before"), ["file", "block"])
    start = F.when(F.col("at") > 0, F.col("tokens_before") + F.col("before") + 1).otherwise(F.coalesce(F.col("last_before") + 1, F.lit(0)))
    closed = joined.select("file", (F.col("docs_before") + F.col("at")).alias("ordinal"), start.cast("long").alias("start"), (F.col("tokens_before") + F.col("end") - start).cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    totals = placed.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.max(F.col("tokens_before") + F.col("last")).alias("last"))
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    tail = totals.where(F.col("tokens") > start).select("file", F.col("docs").alias("ordinal"), start.alias("start"), (F.col("tokens") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def block_starts(blocks: DataFrame) -> DataFrame:
    """Exclusive prefix scan of (tokens, docs, last separator) over the blocks of each file.

    Two levels: inside spans of blocks, then over the spans' totals, so that one very large file
    is scanned by many tasks.
    """
    blocks = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("t", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("d", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    inner = inner.withColumn("l", F.max(F.col("t") + F.col("last")).over(before))
    spans = inner.groupBy("file", "span").agg(F.sum("tokens").alias("st"), F.sum("docs").alias("sd"), F.max(F.col("t") + F.col("last")).alias("sl"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.select("file", "span", F.coalesce(F.sum("st").over(before), F.lit(0)).alias("all_t"), F.coalesce(F.sum("sd").over(before), F.lit(0)).alias("all_d"), "sl")
    outer = outer.withColumn("all_l", F.max(F.col("all_t") + F.col("sl")).over(before)).drop("sl")
    out = inner.join(outer, ["file", "span"])
    return out.select("file", "block", "tokens", "docs", "last", (F.col("t") + F.col("all_t")).alias("tokens_before"), (F.col("d") + F.col("all_d")).alias("docs_before"), F.coalesce(F.col("all_t") + F.col("l"), F.col("all_l")).alias("last_before"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, counted in its token file.

    Null and empty texts count 0; repeated rows count each for itself.
    """
    blocks = write_tokens(docs, vocabulary, end, block_bytes)
    counted = separator_scan(blocks, end).where("closed").drop("closed")
    inside = block_starts(blocks.select("file", "block", F.lit(0).cast("long").alias("tokens"), F.size("names").cast("long").alias("docs"), F.lit(None).cast("long").alias("last")))
    names = blocks.select("file", "block", F.posexplode("names").alias("at", "doc_id"))
    names = names.join(inside.select("file", "block", "docs_before"), ["file", "block"]).select("file", (F.col("docs_before") + F.col("at")).alias("ordinal"), "doc_id")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
