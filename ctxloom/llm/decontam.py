"""Benchmark decontamination: an inverted BM25 index of test items, searched with block-max WAND.

Every training document is cut into overlapping passages, so long that each item lies whole in one,
and every passage is a query. A term's postings are its items in order with their BM25 impacts, as
shares of the score that the item gives itself; each run of ITEMS_PER_BLOCK items has the largest
impact of the term in it, and so has the whole list. Many passages are searched at once: those whose
lists' largest impacts together are below the threshold have no pivot and end there; of the others
the blocks whose largest impacts together reach it are the pivots, and only in these are postings
read and scored. What is above the threshold is verified on the item's question and answer: the share of their n-grams in
the passage or, as one changed word kills several n-grams, that of words left by the least word
edits to any span of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import keep_rows, slices

K1, B = 1.2, 0.75
#: Least BM25 score, as a share of the item's own; least overlaps of question and answer.
THRESHOLD, QUESTION, ANSWER = 0.5, 0.7, 0.5
NGRAM = 5
ITEMS_PER_BLOCK = 16
#: Bounds of one broadcast index; more items take more passes over the documents. A posting takes 8
#: bytes and stands for a word of its item, so an index takes some 3 bytes for each of its texts'.
ITEMS_PER_PASS, BYTES_PER_PASS = 100_000, 16_000_000
LEAST_PASSAGE = 64

_TERM = re.compile(r"[^\W_]+")


def split(words: list[str], text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: the answer is its last line or sentence, or the last quarter of a single one."""
    parts = [p for p in re.split(r"\n|(?<=[.!?])\s", text) if _TERM.search(p)]
    last = len(_TERM.findall(parts[-1].lower())) if len(parts) > 1 else max(1, len(words) // 4)
    return words[:-last] or words, words[-last:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Whole:
    """What scores need to know of all items: their number, words in all and of the longest, and of each term the items with it."""

    n: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """Impacts and block maxima of some items; `whole` describes all items where these are a part."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None) -> None:
        kept = [(key, words, text) for key, text in items if text and (words := _TERM.findall(text.lower()))]
        kept.sort(key=lambda x: (len(x[1]), str(x[0])))
        self.keys = [key for key, _, _ in kept]
        self.words = [words for _, words, _ in kept]
        self.parts = [split(words, text) for _, words, text in kept]
        if whole is None:
            whole = Whole(len(kept), sum(map(len, self.words)), max(map(len, self.words), default=0), Counter(t for w in self.words for t in set(w)))
        self.longest = max(LEAST_PASSAGE, whole.longest)
        self.term = {t: i for i, t in enumerate(sorted({t for w in self.words for t in w}))}
        n, average, df = whole.n, whole.words / max(1, whole.n), whole.df
        terms, items, impacts = [], [], []
        for i, words in enumerate(self.words):
            found = []
            for t, tf in Counter(words).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                found.append((self.term[t], idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))))
            own = sum(x for _, x in found)
            terms += [t for t, _ in found]
            items += [i] * len(found)
            impacts += [x / own for _, x in found]
        self.postings = Postings(np.array(terms, np.int64), np.array(items, np.int64), np.array(impacts), len(self.term))
        blocks = self.postings.places // ITEMS_PER_BLOCK
        self.block_most = Postings(self.postings.owner(), blocks, self.postings.values, len(self.term))
        self.most = self.block_most.largest()

    def scores(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, score) of all that reach the threshold; the terms of each window stand together, windows ascending."""
        least = THRESHOLD - 1e-5
        reach = np.bincount(window, self.most[term])[window] >= least  # all lists at their largest
        window, term = window[reach], term[reach]
        at, block, bound = self.block_most.of(term)
        pivot, bound = _sums(window[at], block, bound)
        pivot = pivot[:, bound >= least]
        if not pivot.shape[1]:
            return (np.zeros(0, np.int64),) * 3
        # the terms of windows with a pivot, and of their postings those in a pivot's block
        inside = np.isin(window, pivot[0])
        window, term = window[inside], term[inside]
        at, item, impact = self.postings.of(term)
        blocks = int(pivot[1].max()) + 1
        code = window[at] * blocks + np.minimum(item // ITEMS_PER_BLOCK, blocks - 1)
        read = np.isin(code, pivot[0] * blocks + pivot[1]) & (item // ITEMS_PER_BLOCK < blocks)
        found, score = _sums(window[at[read]], item[read], impact[read])
        good = score >= least
        return found[0, good], found[1, good], score[good]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score share, question overlap, answer overlap) of verified matches, each row's best passage."""
        if not self.keys:
            return []
        words = [_TERM.findall(t.lower()) if t else [] for t in texts.to_pylist()]
        get, size = self.term.get, self.longest
        n = np.array([len(w) for w in words])
        ids = np.fromiter((get(w, -1) for doc in words for w in doc), np.int64, n.sum())
        windows = np.maximum(1, -(-n // size) - 1)
        base = np.cumsum(windows) - windows
        doc = np.repeat(np.arange(len(words)), n)
        own = (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)) // size
        entries = []
        for back in (0, 1):
            k = own - back
            fits = (ids >= 0) & (k >= 0) & (k < windows[doc])
            entries.append((base[doc[fits]] + k[fits]) * len(self.term) + ids[fits])
        codes = np.unique(np.concatenate(entries))
        out: dict[tuple[int, int], tuple] = {}
        for here, item, score in zip(*(x.tolist() for x in self.scores(codes // len(self.term), codes % len(self.term))), strict=True):
            row = int(np.searchsorted(base, here, "right")) - 1
            first = (here - int(base[row])) * size
            last = first + 2 * size if here - base[row] < windows[row] - 1 else len(words[row])
            question, answer = overlaps(*self.parts[item], words[row][first:last])
            if question >= QUESTION and answer >= ANSWER:
                found = (row, item, first, score, question, answer)
                if (row, item) not in out or found[3:] > out[row, item][3:]:
                    out[row, item] = found
        return list(out.values())


class Postings:
    """For each term, ascending places (items or blocks) with the largest value given for each."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((-values, places, terms))
        terms, places, values = terms[order], places[order], values[order]
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (places[1:] != places[:-1])
        self.places, self.values = places[first].astype(np.int32), values[first].astype(np.float32)
        self.at = np.searchsorted(terms[first], np.arange(n_terms + 1))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def largest(self) -> np.ndarray:
        out = np.zeros(len(self.at) - 1)
        np.maximum.at(out, self.owner(), self.values)
        return out

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All postings of the terms: which of `terms`, place, value."""
        size = self.at[terms + 1] - self.at[terms]
        which = np.repeat(np.arange(len(terms)), size)
        place = np.arange(len(which)) + np.repeat(self.at[terms] - np.cumsum(size) + size, size)
        return which, self.places[place].astype(np.int64), self.values[place].astype(np.float64)


def _sums(first: np.ndarray, second: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by pairs: 2 x pairs, and sums."""
    width = int(second.max()) + 1 if len(second) else 1
    codes, which = np.unique(first * width + second, return_inverse=True)
    return np.stack([codes // width, codes % width]), np.bincount(which, values, len(codes))


def distance(part: list[str], passage: list[str]) -> int:
    """Least word edits between a part and any span of the passage (bit-parallel, Myers 1999)."""
    n = len(part)
    places: dict[str, int] = {}
    for i, word in enumerate(part):
        places[word] = places.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score, best = full, 0, n, n
    for word in passage:
        equal = places.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(across | up)) & full, up & across
        score += bool(more & top) - bool(less & top)
        best = min(best, score)
        more, less = more << 1 & full, less << 1 & full
        vertical = equal | down
        up, down = (less | ~(vertical | more)) & full, more & vertical
    return best


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of a part's n-grams that stand in the passage, or of its words that the least edits leave if it has an n-gram's length."""
    own = grams(part, NGRAM)
    n = min(NGRAM, len(part))
    share = len(own & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(own) if own else 0.0
    return max(share, 1 - distance(part, passage) / len(part)) if share < 1 and len(part) >= NGRAM else share


def overlaps(question: list[str], answer: list[str], passage: list[str]) -> tuple[float, float]:
    """Both parts' overlaps; beside its own a part has what it adds to the other's edits where both stand together."""
    found = overlap(question, passage), overlap(answer, passage)
    if found[0] >= QUESTION and found[1] >= ANSWER or max(found[0] / QUESTION, found[1] / ANSWER) < 1:
        return found
    both = distance(question + answer, passage)
    return tuple(max(f, 1 - (both - distance(other, passage)) / len(part)) for f, part, other in zip(found, (question, answer), (answer, question), strict=True))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The items in as many indexes as their number and bytes ask for; each is bounded, and all score by the counts of all items."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    if passes == 1:
        yield Index([(r["item_id"], r["text"]) for r in items.collect()])
        return

    def terms(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if words := _TERM.findall(text.lower()):
                    own = list(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int64()), pa.array(own, pa.string()), pa.array([len(words)] + [None] * (len(own) - 1), pa.int64())], names=["part", "term", "words"])

    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    seen = materialise(items.select("part", "text").mapInArrow(terms, "part long, term string, words long"), "item_terms")
    totals = [x or 0 for x in seen.agg(F.count("words"), F.sum("words"), F.max("words")).first()]
    counts = materialise(seen.groupBy("term").agg(F.count("*").alias("df")), "item_counts")
    for k in range(passes):
        df = {r["term"]: r["df"] for r in counts.join(seen.where(F.col("part") == k).select("term"), "term", "left_semi").collect()}
        yield Index([(r["item_id"], r["text"]) for r in items.where(F.col("part") == k).collect()], Whole(*totals, df))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, score (share of the item's own BM25), question_overlap, answer_overlap.

    One row for each document and item that it holds. Null and empty texts on either side match
    nothing; repeated documents match each for itself, items of equal text with other ids too; a
    repeated row of the benchmark counts once. Of passages that hold an item equally well the first
    is given.
    """
    spark = docs.sparkSession
    out = None
    for made in indexes(benchmark):
        index = spark.sparkContext.broadcast(made)

        def run(frames: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in slices(frames, 1):
                if found := index.value.search(part.column(1)):
                    rows, items, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array([index.value.keys[i] for i in items], pa.int64()), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])], names=["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

        here = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double")
        out = here if out is None else out.unionByName(here)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Null and empty texts hold none and stay. Each of several equal rows is kept or goes for itself.
    A benchmark without an item with a word leaves all documents.
    """
    spark = docs.sparkSession
    for made in indexes(benchmark):
        index = spark.sparkContext.broadcast(made)

        def free(texts: pa.Array, index=index) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[x[0] for x in index.value.search(texts)]] = False
            return out

        docs = keep_rows(docs, free)
    return docs
