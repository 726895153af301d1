"""Quality rules on repetition, from a suffix array over words.

The words of a text are sorted by their suffixes (prefix doubling); longest common prefixes of
neighbours give, at each word, the longest substring that begins there and stands elsewhere in the
text as well. Those spans are the maximal repeats; their union and the longest of them are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, keep_rows, mix, slices

#: Fixed by the contract of the base rules.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"

#: The method's limits: repeats of at least MIN_REPEAT words may cover so much of the words, and the
#: longest may have so many words, or so much of the text if that is more.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE = 12, 0.25, 50, 0.15

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in SYMBOLS]] = True

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def repeats(words: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """At each word, the length of the longest substring from there that its document has twice or more; below `least`, 0.

    words: hashes; doc: the document of each, ascending. Suffixes of different documents are never
    equal, and none goes beyond its document.
    """
    n = len(words)
    found = np.zeros(n, np.int64)
    if n == 0:
        return found
    _, rank = np.unique(mix(words ^ mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rank, minlength=n), out=starts[1 : 1 + n])
    rank = starts[rank]  # a suffix's rank is the first place of its group
    end = np.searchsorted(doc, np.arange(n_docs), "right")[doc]
    levels, k = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_) or k > n:
            break
        after = open_ + k
        inside = after < end[open_]
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, -open_)  # beyond the document: below all, and unique
        order = np.lexsort((second, rank[open_]))
        first, second, at = rank[open_][order], second[order], open_[order]
        group = np.ones(len(at), bool)
        group[1:] = first[1:] != first[:-1]
        cut = group.copy()
        cut[1:] |= second[1:] != second[:-1]
        here = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(cut, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
        rank = rank.copy()
        rank[at] = first + offset
        levels.append(rank)
        k *= 2
    order = np.argsort(rank, kind="stable")
    p, q = order[:-1], order[1:]
    for level in range(len(levels)):  # neighbours that share the longest power of two within `least`
        if 2 << level > least:
            same = levels[level][p] == levels[level][q]
            p, q = p[same], q[same]
            break
    else:
        p, q = p[:0], q[:0]
    length, a, b = np.zeros(len(p), np.int64), p.copy(), q.copy()
    for level in reversed(range(len(levels))):
        fits = (a < n) & (b < n)
        fits &= doc[np.where(fits, a, 0)] == doc[np.where(fits, b, 0)]
        ranks = levels[level]
        same = fits & (ranks[np.where(fits, a, 0)] == ranks[np.where(fits, b, 0)])
        step = same * (1 << level)
        length, a, b = length + step, a + step, b + step
    np.maximum.at(found, p, length)
    np.maximum.at(found, q, length)
    found[found < least] = 0
    return found


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in the union of the spans that begin at each word with these lengths."""
    at = np.arange(len(lengths))
    reach = np.maximum.accumulate(np.where(lengths > 0, at + lengths, 0)) if len(lengths) else lengths
    return reach > at


def figures(texts: pa.Array) -> list[np.ndarray]:
    """The columns of OUT after doc_id, for a block of texts."""
    block = TextBlock(texts)
    doc, at, n = block.word_doc(), block.doc_words, block.n_words
    found = repeats(block.hashes(block.starts, block.ends), doc, block.n_docs, REPEAT_WINDOW)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[at[1:]] - sums[at[:-1]]

    longest = np.zeros(block.n_docs, np.int64)
    np.maximum.at(longest, doc, found)
    repeated, most = total(covered(found)), total(covered(np.where(found >= MIN_REPEAT, found, 0)))
    points = (block.data & 0xC0) != 0x80
    base_failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    kept = ~base_failed & (most <= MAX_COVERED * n) & (longest <= np.maximum(MAX_LONGEST, MAX_LONGEST_SHARE * n))
    return [n, block.per_doc(points & block.is_word), block.per_doc(_SYMBOL[block.data]), dup_lines(block), repeated, most, longest, base_failed, kept]


def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.split(", ")]
    for part in slices(frames, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, figures(part.column(1)))], names=names)


def dup_lines(block: TextBlock) -> np.ndarray:
    """Lines with a word that equal an earlier line, of each document."""
    out = np.zeros(block.n_docs, np.int64)
    size = len(block.data)
    if size == 0:
        return out
    breaks = np.flatnonzero(block.data == 10)
    starts = np.union1d(breaks + 1, block.doc_at[:-1])
    starts = starts[starts < size]
    ends = np.append(starts[1:], size)
    ends = ends - ((ends > starts) & (block.data[ends - 1] == 10))
    words = np.concatenate([[0], np.cumsum(block.is_word)])
    has = words[ends] > words[starts]
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(block.doc_at, starts, "right") - 1
    keys = mix(block.hashes(starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc, minlength=block.n_docs) - np.bincount(doc[first], minlength=block.n_docs)


def quality(docs: DataFrame) -> DataFrame:
    """Repetition figures of every text, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows and clashing extra columns don't
    matter: only doc_id and text are read, row by row. Work is a map over the table.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, OUT)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null and empty texts go, as they have no words. Each of several equal rows is kept or goes for
    itself, whatever its other columns hold; an empty table gives an empty one.
    """
    return keep_rows(docs, lambda texts: figures(texts)[-1])
