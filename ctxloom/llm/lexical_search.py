"""Ranked lexical search by scanning documents with one automaton of all query terms.

The terms of a bounded set of items become an Aho-Corasick automaton, each between two guards, and
every text is read with each run of other characters as a guard, so that a match is a whole term.
The automaton counts terms straight from the texts; there is no index of documents. A first scan sums
the corpus figures, a second one scores: a term's postings lead to the items that hold it, and
a task keeps the best documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

TOP = 20
#: Bounds of one automaton: items, and bytes of their texts. More items take more scans. An item
#: longer than that has an automaton of its own.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 4 << 20
#: Entries of the documents x items block that a task scores at once.
BLOCK = 4_000_000
#: Sums of integers up to here are exact in doubles.
EXACT = 1 << 53

#: Guards for all bytes that can't be in a term; A-Z become a-z. Every byte from 0x80 on is in a term.
GUARD = 0x20
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = GUARD


def guarded(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """(string, starts, terms): all texts with a guard before and after each, one character a byte; where each begins, an end after the last; terms in each."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    out = np.full(len(raw) + len(texts) + 1, GUARD, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(texts) + 1), np.diff(at))] = _BYTES[raw]
    starts = at + np.arange(len(texts) + 1)
    inside = out != GUARD
    begun = np.zeros(len(out), np.int64)
    np.cumsum(inside[1:] & ~inside[:-1], out=begun[1:])
    return out.tobytes().decode("latin-1"), starts, begun[starts[1:]] - begun[starts[:-1]]


def terms(text: str) -> list[str]:
    """A text's terms, one character a byte."""
    return [word for word in guarded(pa.array([text]))[0].split(" ") if word]


@dataclass
class Items:
    """The items of one pass: an automaton of their terms and, for each term, the items that hold it and how often."""

    keys: list
    words: list[str] = field(default_factory=list)
    at: np.ndarray | None = None
    items: np.ndarray | None = None
    times: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        held: dict[str, Counter] = {}
        for i, (_, texts) in enumerate(rows):
            for word, n in Counter(w for text in texts for w in terms(text)).items():
                held.setdefault(word, Counter())[i] = n
        sizes = [len(x) for x in held.values()]
        pairs = [p for x in held.values() for p in x.items()]
        items, times = np.array(pairs, np.int64).reshape(-1, 2).T
        return cls([key for key, _ in rows], list(held), np.append(0, np.cumsum(sizes)).astype(np.int64), items, times)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def scanner(self):
        """The automaton, made once in a worker."""
        if "automaton" not in self.__dict__:
            import ahocorasick

            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, word in enumerate(self.words):
                made.add_word(f" {word} ", i)
            made.make_automaton()
            self.__dict__["automaton"] = made
        return self.__dict__["automaton"]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """terms in each text; and for each item term in a text: which text, which term, how often."""
        string, starts, n = guarded(texts)
        doc, term, times = [], [], []
        if self.words:
            scanner, which = self.scanner(), itemgetter(1)
            for i in np.flatnonzero(n):
                found = Counter(map(which, scanner.iter(string, int(starts[i]), int(starts[i + 1]) + 1)))
                doc.append(len(found))
                term.extend(found)
                times.extend(found.values())
        filled = np.zeros(len(n), np.int64)
        filled[np.flatnonzero(n)[: len(doc)]] = doc
        return n, np.repeat(np.arange(len(n)), filled), np.array(term, np.int64), np.array(times, np.int64)


@dataclass
class Weights:
    """Corpus figures, and the weight of each term."""

    documents: int
    length: int
    weight: np.ndarray

    @classmethod
    def of(cls, documents: int, length: int, df: np.ndarray) -> Weights:
        return cls(documents, length, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64))

    def of_term(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What each term of a text adds to an item that holds it once."""
        m = np.array([75 + 25 * x * self.documents // self.length if x else 75 for x in n.tolist()], np.int64)
        return self.weight[term] * (1_000_000_000 * times // (1000 * times + 12 * m[doc]))


class Best:
    """The best documents of each item, by score and then id; null ids come last."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top, self.least = top, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, null id, id
        self.waiting, self.n = [], 0

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, id: np.ndarray) -> None:
        self.waiting.append((item, score, null, id))
        self.n += len(item)
        if self.n > 4 * self.top * len(self.least) + 100_000:
            self.settle()

    def settle(self) -> None:
        item, score, null, id = (np.concatenate(x) for x in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((id, null, -score, item))
        item, score, null, id = (x[order] for x in (item, score, null, id))
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        full = place == self.top - 1
        self.least[item[full]] = score[full]
        self.rows = [x[place < self.top] for x in (item, score, null, id)]
        self.waiting, self.n = [], 0


def scores(items: Items, weights: Weights, texts: pa.Array, most_doubles: int = EXACT) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of (first text, texts x items scores)."""
    n, doc, term, times = items.counts(texts)
    added = weights.of_term(n, doc, term, times)
    # a score is at most the sum of an item's weights, times 10^6
    most = np.bincount(items.items, items.times * weights.weight[np.repeat(np.arange(len(items.words)), np.diff(items.at))].astype(float), len(items.keys)).max(initial=0) * 1e6
    n_items, step = len(items.keys), max(1, BLOCK // len(items.keys))
    for first in range(0, len(n), step):
        a, b = np.searchsorted(doc, (first, first + step))
        size = items.at[term[a:b] + 1] - items.at[term[a:b]]
        place = np.arange(size.sum()) + np.repeat(items.at[term[a:b]] - np.cumsum(size) + size, size)
        cell = np.repeat((doc[a:b] - first) * n_items, size) + items.items[place]
        value = np.repeat(added[a:b], size) * items.times[place]
        rows = min(step, len(n) - first)
        if most < most_doubles:
            out = np.bincount(cell, value, rows * n_items).astype(np.int64)
        else:  # in two halves, whose sums are exact
            out = (np.bincount(cell, value >> 26, rows * n_items).astype(np.int64) << 26) + np.bincount(cell, value & ((1 << 26) - 1), rows * n_items).astype(np.int64)
        yield first, out.reshape(rows, n_items)


def _passes(benchmark: DataFrame, n_items: int, n_bytes: int) -> Iterator[Items]:
    """The items, all rows of an id together, in as many bounded sets as their number and bytes ask for."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(-(-n // n_items), -(-size // n_bytes))
    for k in range(passes):
        part = texts.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(passes)) == k)
        held: dict = {}
        for row in part.collect():
            held.setdefault(row["item_id"], []).append(row["text"])
        made = Items.of(list(held.items()))
        if made.words:
            yield made


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best of all docs for each item.

    docs (doc_id, text) and benchmark (item_id, text) with whole-number ids. Null and empty texts have
    no terms: such a document is in no result and no count, such an item has no rows. Several
    texts of one item_id are one item with the terms of all, a repeated row counts once; a null
    item_id is an item. Each row of docs stands for itself, so a repeated row can take two ranks;
    a null doc_id comes after others of equal score. Texts are read whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out = None
    for made in _passes(benchmark, items_per_pass, bytes_per_pass):
        shared = spark.sparkContext.broadcast(made)

        def figures(frames: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            df, documents, length = np.zeros(len(shared.value.words), np.int64), 0, 0
            for part in slices(frames, 0):
                n, _, term, _ = shared.value.counts(part.column(0))
                df += np.bincount(term, minlength=len(df))
                documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            term = np.append(np.flatnonzero(df), (-1, -2))
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.append(df[term[:-2]], (documents, length)))], names=["term", "n"])

        sums = {r["term"]: r["n"] for r in table.select("text").mapInArrow(figures, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        counts = np.zeros(len(made.words), np.int64)
        for term, n in sums.items():
            if term >= 0:
                counts[term] = n
        weights = spark.sparkContext.broadcast(Weights.of(sums.get(-1, 0), sums.get(-2, 0), counts))

        def scan(frames: Iterator[pa.RecordBatch], shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
            items, best = shared.value, Best(len(shared.value.keys), top)
            for part in slices(frames, 1):
                null = np.asarray(part.column(0).is_null())
                ids = np.asarray(part.column(0).fill_null(0))
                for first, block in scores(items, weights.value, part.column(1)):
                    doc, item = np.nonzero(block >= best.least)
                    best.add(item, block[doc, item], null[first + doc].astype(np.int64), ids[first + doc])
            best.settle()
            item, score, null, id = best.rows
            names = pa.array(items.keys, pa.int64()).take(pa.array(item))
            yield pa.RecordBatch.from_arrays([names, pa.array(id, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

        here = table.mapInArrow(scan, "item_id long, doc_id long, score long")
        out = here if out is None else out.unionByName(here)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
