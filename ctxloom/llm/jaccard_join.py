"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

Bands and rows follow from the similarity and the recall wanted at it. Texts are first reduced to
one of each kind (equal bytes). Their band hashes are shuffled. Texts of a small bucket are compared
by short signatures (a byte of each of SIGNATURE hashes) and joined where these are alike enough
that the pair may reach the similarity, so that chance meetings join nothing; texts of a larger
bucket are joined to its first. The components of these edges are the candidate groups. Every group
is cut into blocks of a fixed number of texts, and each pair of blocks is verified in one task from
the sets themselves, so that no task and no row grows with a group. Links are counted there, and
only a spanning forest of them leaves the task; its components are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from .common import TextBlock, mix, shingles, slices

SIMILARITY, WIDTH = 0.8, 5
RECALL = 0.9999
#: A pair of half the similarity may be a candidate with this probability.
STRAY = 0.05
BLOCK = 256
#: Buckets of so many texts are compared by signatures. A pair at the similarity falls this far short
#: of it in SIGNATURE hashes with a probability under 1e-6 (five standard deviations).
SMALL, SIGNATURE, SHORT_OF = 16, 120, 0.2
#: Entries of a dense block while sets are intersected.
DENSE = 4_000_000


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, stray: float = STRAY) -> tuple[int, int]:
    """The fewest hashes in all whose bands find pairs at `similarity` with `recall`."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= stray and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    if best is None:
        raise ValueError("no banding has this recall and so few stray candidates")
    return best


def band_hashes(block: TextBlock, bands: int, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """bands x documents, and documents x SIGNATURE bytes; documents without a word have all ones."""
    hashes, doc = shingles(block, width)
    first = np.searchsorted(doc, np.arange(block.n_docs))
    filled = np.diff(np.append(first, len(doc))) > 0
    out, signature = np.full((bands, block.n_docs), np.iinfo(np.uint64).max, np.uint64), np.full((block.n_docs, SIGNATURE), 255, np.uint8)
    if not filled.any():
        return out, signature
    at = first[filled]
    for band in range(bands):
        total = np.full(filled.sum(), band, np.uint64)
        for row in range(rows):
            seed = np.uint64((0x9E3779B97F4A7C15 * (2 * (band * rows + row) + 1)) & (2**64 - 1))
            least = np.minimum.reduceat((hashes ^ seed) * (seed | np.uint64(1)) >> np.uint64(16), at)
            if band * rows + row < SIGNATURE:
                signature[filled, band * rows + row] = mix(least).astype(np.uint8)
            total = mix(total * np.uint64(31) + least)
        out[band, filled] = total
    return out, signature


def _alike(similarity: float):
    """Rows (members: key and signature of the texts of a small bucket) to edges between those that may reach the similarity."""

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            lists = frame.column(0)
            at, members = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            keys = members.field("key").to_pylist()
            signature = np.frombuffer(b"".join(members.field("signature").to_pylist()), np.uint8).reshape(len(keys), SIGNATURE)
            a, b = [], []
            for first, end in zip(at[:-1], at[1:], strict=True):
                own = signature[first:end]
                same = (own[:, None, :] == own[None, :, :]).mean(2)
                near = (same - 1 / 256) / (1 - 1 / 256) >= similarity - SHORT_OF
                for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                    a.append(keys[first + i])
                    b.append(keys[first + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return compare


def _candidates(sketches: DataFrame, similarity: float) -> DataFrame:
    """a, b: edges whose components hold together all texts that may have the similarity."""
    own = sketches.where("bands is not null").select("key", "bands", "signature").dropDuplicates(["key"])
    hashed = own.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = hashed.groupBy("band", "hash").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    # another key than the aggregate's, so that AQE can split a bucket of very many texts
    bucket = F.xxhash64("band", "hash").alias("bucket")
    members = materialise(hashed.withColumn("bucket", bucket).join(buckets.withColumn("bucket", bucket), ["bucket", "band", "hash"]).select("key", "band", "hash", "b", "n"), "members")
    large = members.where((F.col("n") > SMALL) & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b")
    # at most SMALL texts meet in a row
    small = members.where(F.col("n") <= SMALL).select("key", "band", "hash").join(own.select("key", "signature"), "key")
    small = small.groupBy("band", "hash").agg(F.collect_list(F.struct("key", "signature")).alias("members"))
    return large.union(small.select("members").mapInArrow(_alike(similarity), "a binary, b binary"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of an edge list (a, b): the least node of each connected component; nodes are binary.

    Large-star and small-star steps (Kiveris et al., 2014) until all components are stars; each
    round is written to the shared folder. Nodes without an edge don't appear.
    """

    def edges_of(df: DataFrame) -> DataFrame:
        return df.select("a", "b").union(df.select(F.col("b"), F.col("a"))).toDF("u", "v")

    def large_star(df: DataFrame) -> DataFrame:
        key = _apart("u")
        both = edges_of(df)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(key, "m")
        return both.where("v > u").select(key, "v").join(least, "k").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small_star(df: DataFrame) -> DataFrame:
        down = edges_of(df).where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.select(_apart("u"), "v").join(least.select(_apart("u"), "m"), "k").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def stars(df: DataFrame) -> bool:
        """Whether every node has one edge upwards or is a root."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while not stars(now):
        before, now = now, materialise(small_star(large_star(now)), name)
        discard(before)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _verify(similarity: float, width: int):
    """Rows of one unit (two blocks) stand together; gives links of each text and a forest of them."""

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for frame in frames:
            names = frame.column(0).to_pylist()
            for i, name in enumerate(names):
                if name != unit:
                    if held:
                        yield from solve(held)
                    unit, held = name, []
                held.append((frame.column(1)[i].as_py(), frame.column(2)[i].as_py(), frame.column(3)[i].as_py(), np.frombuffer(frame.column(4)[i].as_buffer(), np.uint64).copy()))
        if held:
            yield from solve(held)

    def solve(held: list) -> Iterator[pa.RecordBatch]:
        rows = list({key: (key, copies, side, items) for key, copies, side, items in held}.values())
        n = len(rows)
        if n < 2:
            return
        sizes = np.array([len(x[3]) for x in rows])
        owner = np.repeat(np.arange(n), sizes)
        _, column, count = np.unique(np.concatenate([x[3] for x in rows]), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.float32)
        step = max(1, DENSE // n)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, [low, low + step])
            part = np.zeros((n, step), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-4
        side = np.array([x[2] for x in rows])
        linked &= (side[:, None] != side[None, :]) | (side == -1)[:, None]
        np.fill_diagonal(linked, False)
        copies = np.array([x[1] for x in rows])
        texts, docs = linked.sum(1), linked @ copies
        keys = [x[0] for x in rows]
        root = np.arange(n)
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True) if linked.any() else ():
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)
        some = np.flatnonzero(texts)
        if len(some):
            top = []
            for i in some:
                while root[i] != i:
                    i = root[i]
                top.append(keys[i])
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(texts[some], pa.int64()), pa.array(docs[some], pa.int64()), pa.array(top, pa.binary())], names=["key", "texts", "docs", "tie"])

    return verify


def join(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id, text_id, n_links, n_text_links, n_copies.

    class_id is the least doc_id of the rows that chains of links join, text_id that of the rows of
    equal text. n_text_links counts other texts with at least the similarity, n_links the rows that
    hold them; n_copies counts rows of the same text besides the row itself. The n-grams of a text
    are its runs of `width` words; a shorter text has one of all its words. Null texts and texts
    without a word have no n-gram and no link; equal ones share a class, as null ones do. Repeated
    rows are copies. Only doc_id and text are read.
    """
    sketches, found = _classes(docs, similarity, width, recall)
    classes = found.groupBy("root").agg(F.min("text_id").alias("class_id")).select(_apart("root"), "class_id")
    found = found.withColumn("k", _apart("root")).join(classes, "k")
    zero = F.lit(0).cast("long")
    out = sketches.select("doc_id", "key").join(found, "key")
    return out.select("doc_id", "class_id", "text_id", F.coalesce("docs", zero).alias("n_links"), F.coalesce("texts", zero).alias("n_text_links"), (F.col("copies") - 1).alias("n_copies"))


def _apart(column: str):
    """The column as another key than an aggregate's, so that a join shuffles both sides for itself and AQE can split a hot key."""
    return F.concat(column, F.lit(b"\0")).alias("k")


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("null"))))


def sketch(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, key (of the text), bands and signature of each row; the last two of texts with a word."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(frames, 2):
            block = TextBlock(part.column(2))
            hashes, signature = band_hashes(block, bands, rows, width)
            some = block.n_words > 0
            lists = [h if s else None for h, s in zip(hashes.T.view(np.int64), some, strict=True)]
            marks = [x.tobytes() if s else None for x, s in zip(signature, some, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "key", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long"), _text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key binary, bands array<long>, signature binary")


def _classes(docs: DataFrame, similarity: float, width: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows by doc_id and text key, and of each text its least doc_id, copies, links and the root of its class."""
    columns, key = docs.select(F.col("doc_id").cast("long"), "text"), _text_key()
    sketches = materialise(sketch(columns, *bands_and_rows(similarity, recall), width), "sketches")
    texts = materialise(sketches.groupBy("key").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies")), "texts")
    edges = _candidates(sketches, similarity)
    linked = _links(columns, key, texts, components(edges, "candidates"), similarity, width)
    counts = linked.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(linked.select(F.col("key").alias("a"), F.col("tie").alias("b")), "classes")
    return sketches, texts.join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _links(columns: DataFrame, key, texts: DataFrame, groups: DataFrame, similarity: float, width: int) -> DataFrame:
    """key, texts, docs, tie for each text and unit in which it has links."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("size")).select(_apart("root"), "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = groups.withColumn("k", _apart("root")).join(sizes, "k").join(texts.withColumnRenamed("key", "node"), "node")
    members = members.select(F.col("node").alias("key"), "root", "text_id", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    own = columns.withColumn("key", key).withColumnRenamed("doc_id", "text_id")
    picked = own.join(members, (own.text_id.eqNullSafe(members.text_id)) & (own.key == members.key)).select(members.key, "root", "copies", "blocks", "block", "text")

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(frames, 5):
            hashes, doc = shingles(TextBlock(part.column(5)), width)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            packed = [np.unique(hashes[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(packed, pa.binary())], names=["key", "root", "copies", "blocks", "block", "items"])

    packed = materialise(picked.mapInArrow(sets, "key binary, root binary, copies long, blocks int, block int, items binary"), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = packed.select("key", "root", "copies", "items", "block", other)
    # side tells the two blocks of a unit apart; a block with itself has -1, so that its pairs count there alone
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    unit = F.concat(F.hex("root"), F.lit("-"), F.least("block", "other"), F.lit("-"), F.greatest("block", "other"))
    # by ranges of a hash, so that large units and many small ones are dealt evenly
    dealt = units.select(F.xxhash64(unit).alias("deal"), unit.alias("unit"), "key", "copies", side.alias("side"), "items").repartitionByRange("deal", "unit").sortWithinPartitions("deal", "unit").drop("deal")
    return materialise(dealt.mapInArrow(_verify(similarity, width), "key binary, texts long, docs long, tie binary"), "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each class exactly one row, that of the least doc_id, with all its columns.

    Null ids come last, and of equal ids the least text key stays. Rows without a word are a class
    for each text. Rows of one id, or of none, with texts of several classes are kept for each.
    """
    found = _classes(docs, SIMILARITY, WIDTH, RECALL)[1]
    least = found.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull(), "text_id", "key")).alias("least"))
    # a long as a string is never empty, so the empty one stands for null
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    keep = least.select(F.col("least.key").alias("__key"), F.coalesce(F.col("least.text_id").cast("string"), F.lit("")).alias("__name"))
    kept = docs.withColumn("__key", _text_key()).withColumn("__name", name).join(keep, ["__key", "__name"], "left_semi")
    return kept.dropDuplicates(["__key", "__name"]).select(*docs.columns)
