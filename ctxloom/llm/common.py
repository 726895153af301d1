"""Shared helpers: vectorised views of Arrow text.

A *word* is a maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Ranges of so many bytes are hashed by a cryptographic function.
LONG_RANGE = 256


def crc_fold(column, modulus: int):
    """crc32 of a value's text, modulo a number of folds."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % modulus


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes; a longer text stands alone."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end
        at = end


def slices(frames: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of the text in `column`.

    Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so that a task
    holds one batch and the work on one slice. A text is never cut: one longer than `limit` is a
    slice of its own, whose work takes some 50 to 100 bytes of memory for each of its bytes.
    """
    for frame in frames:
        for a, b in chunks(frame.column(column), limit):
            yield frame.slice(a, b - a)


def keep_rows(docs: DataFrame, keeps: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text `keeps` is true for; it gets blocks of texts."""
    at = docs.columns.index("text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(frames, at):
            yield part.filter(pa.array(keeps(part.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class TextBlock:
    """Byte positions of words and documents in a block of texts; null counts as empty."""

    SPACE = np.zeros(256, bool)
    SPACE[[0x20, 9, 10, 11, 12, 13]] = True

    def __init__(self, column: pa.Array) -> None:
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.doc_at = offsets - offsets[0]
        self.n_docs = len(column)
        size = len(self.data)
        self.is_word = ~self.SPACE[self.data]
        before = np.zeros(size, bool)
        before[1:] = self.is_word[:-1]
        before[self.doc_at[:-1][self.doc_at[:-1] < size]] = False
        after = np.zeros(size, bool)
        after[:-1] = self.is_word[1:]
        ends = self.doc_at[1:]
        after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(self.is_word & ~before)
        self.ends = np.flatnonzero(self.is_word & ~after) + 1
        #: doc_words[i]:doc_words[i + 1] are the words of document i
        self.doc_words = np.searchsorted(self.starts, self.doc_at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.doc_words)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array over each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.doc_at[1:]] - total[self.doc_at[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
        return range_hashes(self.data, starts, ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of `data`: polynomials modulo 2^64 of short ones, BLAKE2b of long ones.

    A polynomial modulo 2^64 meets for certain long strings (Thue-Morse words of 2^11 bytes and
    more) whatever its base; under LONG_RANGE bytes it has no such pairs.
    """
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_RANGE):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(block: TextBlock, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and their documents; a shorter text has one of all its words."""
    words, n, at = block.hashes(block.starts, block.ends), block.n_words, block.doc_words[:-1]
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(block.n_docs), size)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + at[doc]
    total = np.zeros(len(doc), np.uint64)
    for k in range(width):
        there = k < n[doc]
        total = total * np.uint64(_BASE) + np.where(there, words[np.where(there, first + k, 0)], np.uint64(0)) if len(words) else total
    return mix(total), doc


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TABLES: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < size:
        size = max(size, CHUNK_BYTES + CHUNK_BYTES // 2)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _TABLES[:] = tables
    return _TABLES[0], _TABLES[1]
