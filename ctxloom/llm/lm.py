"""Language-model scoring with a probabilistic suffix tree over words.

Texts are lower-cased in A-Z; tokens are words and one end for each text. A context is the last one
to DEPTH symbols. It is kept if it stands in training texts LEAST times or more and the
distribution of what follows it diverges from that after its longest kept suffix by more bits than
it costs to write down. Distributions are smoothed towards that suffix's, and at the root they are
the base score's. A token is scored from the longest kept suffix of what stands before it.

Symbols are the words that make up FREQUENT of all tokens (at most 1 / FREQUENT of them), the end,
and CLASSES classes into which all rarer words are hashed; a word has the share of its class that it
has in the base. The tree itself grows with the corpus, so it is built in two parts:

* the crown: contexts that make up MIN_CONTEXT of all tokens, so DEPTH / MIN_CONTEXT at most. Their
  counts are gathered, and the crown is broadcast. It lists next symbols of MIN_SYMBOL at least.
* the branches: all rarer contexts, as many as the corpus has. Every token goes to the bucket of its
  shortest context outside the crown, and so meets there all tokens with that context or a longer
  one. The bucket counts, decides on and applies its part of the tree in one task; what returns is
  the gain of each text. Tokens travel as packed columns, a few bytes each. A bucket has about
  BUCKET_TOKENS tokens, or as many as its largest context, which is less than MIN_CONTEXT of all.

Counts are over all training texts. All rarer words are joined with their counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import chunks, crc_fold, mix, range_hashes, slices

FOLDS = 10
DEPTH = 3
MIN_SYMBOL, MIN_CONTEXT, MIN_NEXT = 1e-4, 1e-3, 1e-3
#: Occurrences in training texts that a context of the branches needs.
LEAST = 2
#: Weight, in tokens, of the shorter context in the crown's distributions; in the branches it is the number of symbols that follow.
SMOOTHING = 20.0
#: Stands for the end of a text among the words; no word holds a line feed.
END = "\n"
#: Counts a task holds before it sums them up, and distinct words before it passes the sums on.
HELD_ROWS, HELD_WORDS = 1_000_000, 300_000
#: Words that make up so much of all tokens are symbols of their own and looked up in the tasks; at most 1 / FREQUENT.
FREQUENT = 7e-7
CLASSES = 4096
BUCKET_TOKENS = 1_000_000
#: Tokens that a task holds before it deals them out, and bytes of text or symbols that it works on at once.
HELD_TOKENS, TEXT_BYTES = 1_000_000, 4 << 20


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each has; the ends are left out."""
    if texts.null_count:
        texts = texts.fill_null("")
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    words, n = lists.flatten(), pa.compute.list_value_length(lists).to_numpy()
    real = pa.compute.not_equal(words, "")  # white space at either end of a text leaves an empty string
    doc = np.repeat(np.arange(len(n)), n)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(doc, minlength=len(n))


def word_class(words: pa.Array) -> np.ndarray:
    """A class from 0 to CLASSES - 1 of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    return (range_hashes(data, at[:-1] - at[0], at[1:] - at[0]) % np.uint64(CLASSES)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: every token of every text, and how often it stands in training texts."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            total = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
            held[:] = [total.rename_columns(["word", "c"])]
            return total.rename_columns(["word", "c"]).combine_chunks().to_batches()[0]

        for frame in slices(frames, 0, TEXT_BYTES):
            learned = pa.compute.invert(frame.column(1))
            for texts, weight in ((frame.column(0).filter(learned), 1), (frame.column(0).filter(pa.compute.invert(learned)), 0)):
                words, _ = tokens(texts)
                found = pa.compute.value_counts(pa.concat_arrays([words, pa.array([END] * len(texts), pa.string())]))
                held.append(pa.table([found.field(0), pa.compute.multiply(found.field(1), weight)], names=["word", "c"]))
                size += len(found)
            if size > HELD_ROWS:
                if len(out()) > HELD_WORDS:
                    yield held.pop().combine_chunks().to_batches()[0]
                size = sum(map(len, held))
        if size:
            yield out()

    return docs.select("text", "held_out").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Crown:
    """Frequent contexts by level, kept ones' states, and how much each makes a listed symbol likelier than the base does (log10)."""

    size: int
    frequent: list[np.ndarray]  # by level, codes of all contexts that make up MIN_CONTEXT, ascending
    codes: list[np.ndarray]  # by level, those kept, ascending
    states: list[np.ndarray]
    parent: np.ndarray
    escape: np.ndarray
    pairs: np.ndarray  # state * size + symbol, ascending
    gains: np.ndarray

    def gain(self, before: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """For each symbol after its context; before[k] is the symbol k + 1 places before it, 0 beyond the text's start and for rarer words."""
        state = np.zeros(len(symbols), np.int64)
        for level, codes in enumerate(context_codes(before, self.size)):
            at, hit = _find(self.codes[level], codes)
            state[hit] = self.states[level][at[hit]]
        out, open_ = np.zeros(len(symbols)), np.flatnonzero(state)
        while len(open_) and len(self.pairs):
            at, hit = _find(self.pairs, state[open_] * self.size + symbols[open_])
            out[open_] += np.where(hit, self.gains[at], self.escape[state[open_]])
            open_ = open_[~hit]
            state[open_] = self.parent[state[open_]]
            open_ = open_[state[open_] > 0]
        return out

    def root_level(self, before: list[np.ndarray]) -> np.ndarray:
        """Length of the shortest context that isn't frequent; DEPTH + 1 if all are."""
        out, open_ = np.ones(len(before[0]), np.int64), np.arange(len(before[0]))
        for level in range(DEPTH):
            codes = context_codes([b[open_] for b in before[: level + 1]], self.size)[level]
            open_ = open_[_find(self.frequent[level], codes)[1]]
            out[open_] += 1
        return out


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values, and which are there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def preceding(symbols: np.ndarray) -> list[np.ndarray]:
    """The symbols 1 to DEPTH places before each; 0 beyond its text's start. A text begins after each end (symbol 1)."""
    n, before, out = len(symbols), symbols, []
    for _ in range(DEPTH):
        shifted = np.zeros(n, np.int64)
        shifted[1:] = before[:-1]
        shifted[1:][symbols[:-1] == 1] = 0  # the first symbol of a text has none before it, and so on
        before = shifted
        out.append(before)
    return out


def context_codes(before: list[np.ndarray], size: int) -> list[np.ndarray]:
    """By level, the code of the context; -1 where it goes beyond the text's start or holds a symbol that isn't told apart."""
    out, code, whole = [], np.zeros(len(before[0]), np.int64), np.ones(len(before[0]), bool)
    for level, symbol in enumerate(before):
        code, whole = code + symbol * size**level, whole & (symbol > 0) & (symbol < size)
        out.append(np.where(whole, code, -1))
    return out


def coarse(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of words beyond the crown's symbols are 0, which stands for all of them."""
    return np.where(codes < size, codes, 0).astype(np.int64)


def sequences_of(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after the other, and where each text begins; the last place is their number."""
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1] // 4
    return np.frombuffer(codes.buffers()[2], "<i4")[at[0] : at[-1]], at.astype(np.int64) - at[0]


def count_contexts(sequences: DataFrame, size: int, level: int, wanted: np.ndarray | None) -> DataFrame:
    """context, symbol, n: what follows contexts of so many symbols in training texts; wanted: their suffixes to count after."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, 0, TEXT_BYTES):
            symbols = coarse(sequences_of(frame.column(0))[0], size)
            codes = context_codes(preceding(symbols), size)
            here = codes[level - 1] >= 0
            if wanted is not None:
                here &= np.isin(codes[level - 2], wanted)
            pairs, n = np.unique(codes[level - 1][here] * size + symbols[here], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // size), pa.array(pairs % size), pa.array(n)], names=["context", "symbol", "n"])

    counted = sequences.where("not held_out").select("codes").mapInArrow(count, "context long, symbol long, n long")
    return materialise(counted.groupBy("context", "symbol").agg(F.sum("n").alias("n")), f"contexts{level}")


def fit_crown(sequences: DataFrame, root: np.ndarray, total: int) -> Crown:
    """root: the base's probability of each symbol; total: training tokens."""
    size, wanted, found, frequent = len(root), None, [], []
    for level in range(1, DEPTH + 1):
        counts = count_contexts(sequences, size, level, wanted)
        sums = counts.groupBy("context").agg(F.sum("n").alias("t")).where(F.col("t") >= MIN_CONTEXT * total)
        wanted = np.sort(sums.select("context").toArrow()["context"].to_numpy())
        found.append(counts.join(sums, "context").where(F.col("n") >= MIN_NEXT * F.col("t")).toArrow())
        frequent.append(wanted)
    kept: dict[tuple[int, int], int] = {}
    dense = [root]
    parents, escapes, pairs, gains = [0], [0.0], [], []
    for level, listed in enumerate(found, 1):
        context, symbol, n, t = (listed[x].to_numpy() for x in ("context", "symbol", "n", "t"))
        order = np.argsort(context, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(context[order])) + 1) if len(order) else []:
            code, sum_, a, k = int(context[rows[0]]), float(t[rows[0]]), symbol[rows], n[rows].astype(float)
            parent = next((kept[shorter, code % size**shorter] for shorter in range(level - 1, 0, -1) if (shorter, code % size**shorter) in kept), 0)
            above = dense[parent]
            rest, rest_above = sum_ - k.sum(), max(1 - above[a].sum(), 1e-12)
            bits = (k * np.log2(k / sum_ / above[a])).sum() + (rest * np.log2(rest / sum_ / rest_above) if rest > 0 else 0)
            if bits <= (len(a) + 1) * np.log2(sum_) / 2:
                continue
            own = (k + SMOOTHING * above[a]) / (sum_ + SMOOTHING)
            share = max(1 - own.sum(), 1e-12) / rest_above
            full = above * share
            full[a] = own
            state = kept[level, code] = len(dense)
            dense.append(full)
            parents.append(parent)
            escapes.append(np.log10(share))
            pairs.append(state * size + a)
            gains.append(np.log10(own / root[a]))
    codes, states = [], []
    for level in range(1, DEPTH + 1):
        own = sorted((code, state) for (at, code), state in kept.items() if at == level)
        codes.append(np.array([x for x, _ in own], np.int64))
        states.append(np.array([x for _, x in own], np.int64))
    flat, value = (np.concatenate(x) if x else np.zeros(0) for x in (pairs, gains))
    order = np.argsort(flat)
    return Crown(size, frequent, codes, states, np.array(parents), np.array(escapes), flat[order].astype(np.int64), value[order])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 32-bit figures as compressed byte planes."""
    planes = np.concatenate([c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns]).tobytes()
    return len(columns[0]).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(blob: pa.Buffer, columns: int) -> np.ndarray:
    """columns x figures."""
    n = int.from_bytes(blob[:4].to_pybytes(), "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[4:], 4 * n * columns), np.uint8)
    return planes.reshape(columns, 4, n).transpose(0, 2, 1).copy().view("<u4").reshape(columns, n)


def branch_ratios(before: list[np.ndarray], symbols: np.ndarray, level: np.ndarray, learned: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """How many times likelier than `p` the tokens of a bucket are by the branches of the tree that end in its contexts.

    level: length of each token's shortest context outside the crown; learned: whether it counts;
    p: its probability by the crown.
    """
    ratio, q = np.ones(len(symbols)), p
    places, context = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    learned = learned.astype(np.float64)
    for k in range(1, DEPTH + 1):
        # contexts of k symbols, of those of k - 1 that stand often enough; a token's first such context is its root
        _, context = _groups(context * size + before[k - 1])
        started, there = level <= k, before[k - 1] > 0
        t = np.bincount(context, learned)
        often = there & ((t[context] >= LEAST) | ~started)
        if not often.all():
            places, context, symbols, level, learned, q = (x[often] for x in (places, context, symbols, level, learned, q))
            before, started = [x[often] for x in before], started[often]
        if not len(places):
            break
        firsts, pair = _groups(context * size + symbols)
        n = np.bincount(pair, learned)
        follow = np.bincount(context[firsts][n > 0], minlength=len(t))
        n, total = n[pair], t[context]
        bits = np.bincount(context, np.where(learned > 0, np.log2(np.maximum(n, 1) / (np.maximum(total, 1) * q)), 0), len(t))
        kept = bits > (follow + 1) * np.log2(np.maximum(t, 1)) / 2
        on, weight = np.flatnonzero(kept[context] & started), follow[context]
        q = q.copy()
        q[on] = (n[on] + weight[on] * q[on]) / (total[on] + weight[on])
        ratio[places[on]] = q[on] / p[places[on]]
    return ratio


def _groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct code, and the number from 0 of the code at each place."""
    number, distinct = pd.factorize(codes)
    firsts = np.empty(len(distinct), np.int64)
    firsts[number[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return firsts, number


def branch_gains(sequences: DataFrame, crown: Crown, root: np.ndarray, total: int) -> DataFrame:
    """row, gain: the sum over each text of what the branches add to log10 of the crown's probabilities.

    sequences (row, held_out, codes); the upper 28 bits of `row` name the partition that wrote it.
    root: the base's probability of each symbol.
    """
    size, buckets = len(root), max(1, -(-total // BUCKET_TOKENS))
    shared = sequences.sparkSession.sparkContext.broadcast((crown, root))

    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, origin = 0, None

        def out() -> pa.RecordBatch:
            rows, learned, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            before = preceding(codes)
            level = shared.value[0].root_level(before)
            outside = np.flatnonzero(np.choose(level, [0, *before, 0]) > 0)
            level, codes, rows, learned, *before = (x[outside] for x in (level, codes, rows, learned, *before))
            key = mix(before[0].astype(np.uint64))
            for k in range(1, DEPTH):
                deeper = level > k
                key[deeper] = mix(key[deeper] * np.uint64(31) + before[k][deeper].astype(np.uint64))
            bucket = (key % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            columns = [x[order].astype("<u4") for x in (rows & (1 << 36) - 1, level + 4 * learned, codes, *before)]
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            blobs = [pack(*(c[at[i] : at[i + 1]] for c in columns)) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([origin] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "origin", "tokens"])

        for frame in slices(frames, 2, TEXT_BYTES):
            rows, learned = frame.column(0).to_numpy(), ~frame.column(1).to_numpy(zero_copy_only=False)
            codes, at = sequences_of(frame.column(2))
            n = np.diff(at)
            cuts = np.flatnonzero(np.diff(rows >> 36)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if held and (size > HELD_TOKENS or origin != rows[a] >> 36):
                    yield out()
                    size = 0
                origin = int(rows[a]) >> 36
                held.append((np.repeat(rows[a:b], n[a:b]), np.repeat(learned[a:b], n[a:b]), codes[at[a] : at[b]]))
                size += int(at[b] - at[a])
        if held:
            yield out()

    def settle(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crown, root = shared.value

        def out(origins: list[int], blobs: list[np.ndarray]) -> pa.RecordBatch:
            row, flags, symbols, *before = (c.astype(np.int64) for c in np.concatenate(blobs, axis=1))
            known = [coarse(b, crown.size) for b in before]
            p = root[symbols] * 10.0 ** crown.gain(known, coarse(symbols, crown.size))
            gains = np.log10(branch_ratios(before, symbols, flags & 3, flags >> 2 == 1, p, size))
            ends = np.cumsum([b.shape[1] for b in blobs])
            made = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                first = np.flatnonzero(np.append(True, row[a + 1 : b] != row[a : b - 1]))
                sums = np.add.reduceat(gains[a:b], first).astype("<f4")
                some = sums != 0
                made.append(pack(row[a:b][first][some], sums[some].view("<u4")))
            return pa.RecordBatch.from_arrays([pa.array(origins, pa.int64()), pa.array(made, pa.binary())], names=["origin", "gains"])

        now, origins, blobs = None, [], []
        for frame in frames:
            for bucket, origin, blob in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2), strict=True):
                if bucket != now and blobs:
                    yield out(origins, blobs)
                    origins, blobs = [], []
                now = bucket
                origins.append(origin)
                blobs.append(unpack(blob.as_buffer(), 3 + DEPTH))
        if blobs:
            yield out(origins, blobs)

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0)

        def out() -> pa.RecordBatch:
            some = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array((now << 36) + some), pa.array(sums[some])], names=["row", "gain"])

        for frame in frames:
            for origin, blob in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                if origin != now:
                    if now is not None:
                        yield out()
                    now, sums = origin, np.zeros(0)
                row, gain = unpack(blob.as_buffer(), 2)
                if len(row):
                    sums = np.concatenate([sums, np.zeros(max(0, int(row[-1]) + 1 - len(sums)))])
                    np.add.at(sums, row, gain.copy().view("<f4"))
        if now is not None:
            yield out()

    dealt = sequences.select("row", "held_out", "codes").mapInArrow(deal, "bucket long, origin long, tokens binary").repartition("bucket").sortWithinPartitions("bucket")
    settled = dealt.mapInArrow(settle, "origin long, gains binary").repartition("origin").sortWithinPartitions("origin")
    return settled.mapInArrow(gather, "row long, gain double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Null and empty texts are the end alone. A null doc_id is not held out, so its text is learned
    from. Without training texts N and V are 0, no context is kept and both scores are equal.
    Repeated rows are scored each for itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    words = materialise(count_words(rows), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    bottom = total + 0.1 * (distinct + 1)
    is_common = (F.col("c") >= FREQUENT * total) & (F.col("c") > 0)
    common = words.where(is_common & (F.col("word") != END)).orderBy(F.desc("c"), "word").toArrow()
    ends = words.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    def classify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames, 0):
            yield pa.RecordBatch.from_arrays([pa.array(word_class(frame.column(0))), frame.column(1)], names=["class", "c"])

    masses = np.full(CLASSES, 0.1 / CLASSES)  # a word that training texts lack may be of any class
    for r in words.where(~is_common & (F.col("c") > 0) & (F.col("word") != END)).select("word", "c").mapInArrow(classify, "class long, c long").groupBy("class").agg(F.sum(F.col("c") + 0.1).alias("mass")).collect():
        masses[r["class"]] += r["mass"]
    # symbol 0 is none, 1 the end; common words and then classes follow
    counts = np.concatenate([[0, ends], common["c"].to_numpy()]).astype(np.float64)
    first_class = len(counts)
    root = np.concatenate([counts + 0.1, masses]) / bottom
    logs = np.log10(root)
    logs[first_class:] = 0.0
    size = 2 + int((counts[2:] >= MIN_SYMBOL * total).sum())  # the crown's symbols are the first of the common words
    crown_root = root[:size].copy()
    crown_root[0] = max(1 - crown_root[1:].sum(), 1e-9)  # of all rarer words together
    known = spark.sparkContext.broadcast(common["word"].combine_chunks())

    def first(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for frame in slices(frames, 2, TEXT_BYTES):
            words, n = tokens(frame.column(2))
            ids = pa.compute.index_in(words, value_set=known.value)
            missing = ids.is_null()
            rare = words.filter(missing)
            missing = missing.to_numpy(zero_copy_only=False)
            missed = np.concatenate([[0], np.cumsum(missing)])
            at = np.concatenate([[0], np.cumsum(n)])
            codes = ids.fill_null(0).to_numpy() + 2
            codes[missing] = np.concatenate([np.zeros(0, np.int64), *(word_class(rare.slice(a, b - a)) for a, b in chunks(rare))]) + first_class
            codes = np.insert(codes, at[1:], 1).astype(np.int32)
            ends = pa.array((at + np.arange(len(at))) * 4, pa.int32())
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(codes)])
            rare_lists = pa.ListArray.from_arrays(pa.array(missed[at], pa.int32()), rare)
            rows = pa.array(row + np.arange(len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays([rows, frame.column(0), frame.column(1), packed, rare_lists], names=["row", "doc_id", "held_out", "codes", "rare"])

    parts = materialise(rows.mapInArrow(first, "row long, doc_id long, held_out boolean, codes binary, rare array<string>"), "codes")
    crown = fit_crown(parts, crown_root, total)
    shared = spark.sparkContext.broadcast((crown, logs))

    def rate(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crown, logs = shared.value
        for frame in slices(frames, 3, TEXT_BYTES):
            flat, at = sequences_of(frame.column(3))
            symbols = coarse(flat, crown.size)
            figures = ((flat < first_class) & (flat > (0 if ends else 1)), logs[flat], crown.gain(preceding(symbols), symbols))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in figures]
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(np.diff(at)), *map(pa.array, sums)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "gain"])

    rated = parts.select("row", "doc_id", "held_out", "codes").mapInArrow(rate, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double")
    c, zero = F.col("c"), F.lit(0.0)
    rare = parts.select("row", F.explode("rare").alias("word")).join(words, "word").groupBy("row").agg(F.count_if(c > 0).alias("more"), F.sum(F.log10((c + 0.1) / F.lit(bottom))).alias("more_base"))
    # a table of its own, so that the tokens' shuffle is over before that of the rarer words begins
    branches = materialise(branch_gains(parts, crown, root, total), "gains").withColumnRenamed("gain", "more_gain")
    base_score = F.col("base") + F.coalesce("more_base", zero)
    out = rated.join(rare, "row", "left").join(branches, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("gain") + F.coalesce("more_gain", zero)).alias("score"))
