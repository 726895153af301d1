"""Toxicity from a learned lexicon: Levenshtein automata over a trie, and context windows.

Terms are learned from labelled documents: words, and word beginnings that go on in several ways,
that stand almost only in toxic ones. A word is looked up in the trie exactly, by its beginning, or
by an automaton that allows one edit (insertion, deletion, substitution or swap of neighbours) in
a term or in the stem that a word begins with; in those of four letters only the last two kinds,
at half the weight. Words that clean documents of the sample use are no misspellings.
Every hit is weighed by its window of words: signs of quotation (quotation marks around it, words
of reporting) against signs of abuse (other hits, address, exclamation). A logistic model fitted on
the labelled sample turns the sums into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import TextBlock, crc_fold, shingles, slices

FOLDS, HELD_OUT = 3, 1
#: Labelled rows of either class that are learned from, about; a bound, whatever the tables' size.
SAMPLE_PER_CLASS = 4000
#: A term must stand in so many toxic sample documents (or such a share of them), and in so few others for each of them.
MIN_SUPPORT, MIN_SHARE, MAX_CLEAN_SHARE = 5, 0.01, 0.1
MIN_STEM, MAX_STEM, MIN_FUZZY = 4, 24, 5
#: Shorter terms of this length may have a letter changed or two swapped, and a hit weighs this much.
MIN_SHORT, SHORT_WEIGHT = 4, 0.5
#: Whole words are terms from this length on; a word in so many clean sample documents is no misspelling.
MIN_WORD, MIN_KNOWN = 2, 2
WINDOW = 8
THRESHOLD = 0.7

#: Words of reporting and of address, in the languages of the tables.
REPORTING = set("said says called calls calling term word words quote quoted wrote reported claims slur dit appelle mot terme cite sagte nannte wort begriff zitat dijo llama palabra cita".split())
ADDRESS = set("you your you're youre u ur yourself tu toi vous votre du dich dein ihr euch tú ti usted".split())
QUOTES = "\"“”„«»‘‹›"

_WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")


#: Marks a stem's node in the trie, where any ending is accepted; longer than a character.
ANY = "any"


def _cut(word: str) -> list[str]:
    """The word without each of its characters."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


@dataclass
class Lexicon:
    """Whole terms, and stems that any ending may follow, in a trie; `known` words are no misspellings."""

    terms: set[str]
    stems: set[str]
    trie: dict = field(default_factory=dict)
    known: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for mark, kind in (("", self.terms), (ANY, self.stems)):
            for term in kind:
                node = self.trie
                for char in term:
                    node = node.setdefault(char, {})
                node[mark] = term
        self.lengths = sorted({len(x) for x in self.stems})
        # two words one edit apart are equal after at most one character is cut from each
        self.cut_terms = {y for x in self.terms if len(x) >= MIN_SHORT for y in (x, *_cut(x))}
        self.cut_stems = {y for x in self.stems if len(x) >= MIN_SHORT for y in (x, *_cut(x))}
        self.memo: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """0: no hit, 1: exact, 2: stem, 3: one edit away, 4: one edit away from four letters."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            found = self.memo[word] = self._kind(word)
        return found

    def _kind(self, word: str) -> int:
        if word in self.terms:
            return 1
        if any(word[:n] in self.stems for n in self.lengths):
            return 2
        if word not in self.known and self._maybe_near(word) and (term := self.near(word)):
            return 3 if len(term) >= MIN_FUZZY else 4
        return 0

    def _maybe_near(self, word: str) -> bool:
        if len(word) < MIN_SHORT:
            return False
        if word in self.cut_terms or not self.cut_terms.isdisjoint(_cut(word)):
            return True
        return any(word[: n - 1] in self.cut_stems or not self.cut_stems.isdisjoint(_cut(word[:n])) or not self.cut_stems.isdisjoint(_cut(word[: n + 1])) for n in self.lengths)

    def near(self, word: str) -> str | None:
        """A term within one edit of the word, or a stem of one of its beginnings, if one of MIN_FUZZY characters then that; the automaton's states are rows of edit distances."""
        first = list(range(len(word) + 1))
        todo = [(self.trie, first, None, "")]
        short = None
        while todo:
            node, row, above, last = todo.pop()
            for char, child in node.items():
                if char == "" or char == ANY:
                    size = len(child)
                    if size >= MIN_FUZZY:
                        if row[-1] <= 1 or char == ANY and min(row) <= 1:
                            return child
                    elif size >= MIN_SHORT and (len(word) == size or char == ANY and len(word) > size) and row[size] <= 1:
                        short = child
                    continue
                new = [row[0] + 1]
                for i, own in enumerate(word, 1):
                    best = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (own != char))
                    if above and i > 1 and own == last and word[i - 2] == char:
                        best = min(best, above[i - 2] + 1)
                    new.append(best)
                if min(new) <= 1 or min(row) <= 1:
                    todo.append((child, new, row, char))
        return short


def signals(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Weighed hits: exact, by stem, by one edit; and quoted ones."""
    out = [0.0, 0.0, 0.0, 0.0]
    if not text:
        return tuple(out)
    low = text.lower()
    words = _WORD.findall(low)
    kinds = list(map(lexicon.kind, words))
    hits = [i for i, k in enumerate(kinds) if k]
    if hits:
        spans = [m.span() for m in _WORD.finditer(low)]
        for i in hits:
            a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            left, right = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
            around = words[a:i] + words[i + 1 : b]
            quoted = 2.0 * (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)) + sum(w in REPORTING for w in around)
            abuse = sum(map(bool, kinds[a:i] + kinds[i + 1 : b])) + sum(w in ADDRESS for w in around) + ("!" in right)
            share = quoted / (1 + quoted + abuse)
            weight = 1.0 if kinds[i] < 4 else SHORT_WEIGHT
            out[min(kinds[i], 3) - 1] += weight * (1 - share)
            out[3] += weight * share
    return tuple(out)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # intercept first

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(x) @ self.weights[1:] + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; hits never speak against toxicity, quoted ones never for it more than plain ones."""
    x = np.hstack([np.ones((len(x), 1)), np.log1p(x)])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.5 * np.array([0, *w[1:]])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, grad)
    w[1:4] = np.maximum(w[1:4], 0)
    w[4] = min(w[4], w[1] / 4)
    return w


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Lexicon and weights from a bounded sample of the labelled training documents, by a hash of doc_id."""
    spark = docs.sparkSession
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / max(1, sum(n for k, n in counts.items() if k != 1))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found = (Counter(), Counter()), set()
        for frame in slices(frames, 0):
            for text, label in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                for word in set(_WORD.findall(text.lower())):
                    longest = min(len(word), MAX_STEM)
                    here = [word[:n] for n in range(MIN_STEM, longest + 1)]
                    if longest == len(word) >= MIN_WORD:
                        here.append(word + "$")
                    found.update(here)
                seen[label == 1].update(found)
                found.clear()
        starts = [*seen[0], *(x for x in seen[1] if x not in seen[0])]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.string()), pa.array([seen[1][x] for x in starts], pa.int64()), pa.array([seen[0][x] for x in starts], pa.int64())], names=["start", "bad", "good"])

    starts = materialise(_distinct(sample).mapInArrow(count, "start string, bad long, good long").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "starts")
    bad_docs, good_docs = max(1, min(per_class, counts.get(1, 0))), max(1, min(per_class, sum(n for k, n in counts.items() if k != 1)))
    precise = F.col("good") / good_docs <= MAX_CLEAN_SHARE * F.col("bad") / bad_docs
    found = starts.where((F.col("bad") >= max(MIN_SUPPORT, MIN_SHARE * bad_docs)) & precise).toArrow().to_pylist()
    lexicon = choose({r["start"]: r["bad"] for r in found})

    def close(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array([w for x in frame.column(0).to_pylist() if lexicon.kind(w := x[:-1]) > 2], pa.string())], names=["word"])

    clean = starts.where(F.col("start").endswith("$") & (F.col("good") >= MIN_KNOWN) & ~precise).select("start")
    lexicon = Lexicon(lexicon.terms, lexicon.stems, known={r["word"] for r in clean.mapInArrow(close, "word string").collect()})

    def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, 0):
            x = np.array([signals(t, lexicon) for t in frame.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([frame.column(1), *(pa.array(c) for c in x.T)], names=["toxic", "a", "b", "c", "d"])

    rows = sample.mapInArrow(measure, "toxic int, a double, b double, c double, d double").toArrow()
    if rows.num_rows == 0:
        return Model(lexicon, np.array([-4.0, 4, 4, 3, 1]))
    y = (rows["toxic"].to_numpy() == 1).astype(float)
    weight = np.where(y > 0, counts.get(1, 1) / max(1, (y > 0).sum()), (sum(counts.values()) - counts.get(1, 0)) / max(1, (y == 0).sum()))
    return Model(lexicon, _logistic(np.column_stack([rows[c].to_numpy() for c in "abcd"]), y, weight * len(y) / weight.sum()))


def _distinct(sample: DataFrame) -> DataFrame:
    """The least text of those that share their smallest shingle hash, so that copies don't make their words terms."""

    def key(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, 0):
            block = TextBlock(frame.column(0))
            hashes, doc = shingles(block)
            least = np.full(block.n_docs, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, doc, hashes)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(least.view(np.int64))], names=["text", "toxic", "key"])

    return sample.mapInArrow(key, "text string, toxic int, key long").groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def choose(support: dict[str, int]) -> Lexicon:
    """Of precise beginnings (`$` marks a whole word) those with no shorter precise one, as long as one ending does not explain them."""
    terms, stems = set(), set()
    starts = [x for x in support if not x.endswith("$")]
    shortest = [x for x in starts if not any(x[:n] in support for n in range(MIN_STEM, len(x)))]
    children: dict[str, list[str]] = {}
    for x in support:
        children.setdefault(x[:-1], []).append(x)
    for stem in shortest:
        while True:
            best = max(children.get(stem, []), key=lambda x: support[x], default=None)
            if best is None or support[best] < 0.95 * support[stem]:
                stems.add(stem)
                break
            if best.endswith("$"):
                terms.add(best[:-1])
                break
            stem = best
    terms |= {x[:-1] for x in support if x.endswith("$") and not any(x[:n] in support for n in range(MIN_STEM, len(x) - 1)) and x[:-1] not in support}
    return Lexicon(terms, stems - terms)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; more columns hold the weighed hits.

    Null and empty texts have no hit and the model's lowest score. Labels of unknown documents and
    null labels are ignored; a document with several is toxic if one says so. A null doc_id is not held out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, per_class))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, 2):
            x = np.array([signals(t.as_py(), model.value.lexicon) for t in frame.column(2)]).reshape(-1, 4)
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *(pa.array(c) for c in x.T)], names=["doc_id", "held_out", "score", "predicted", "exact", "stem", "misspelled", "quoted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, exact double, stem double, misspelled double, quoted double")
