"""Vector search by short codes: product-quantised residuals in lists that grow with the table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..scratch import materialise
from .rank import top_k

#: Centres of all lists go to every task: at 64 dimensions 4 MB.
MOST_LISTS = 16384
#: Rows of the sample that a list is fitted on; so the sample has at most 262,144 rows.
SAMPLE = 16
#: Values of one byte of a code.
VALUES = 256
#: Rows and queries of a block; a block of each meet as one row of a join.
ROWS, QUERIES = 1024, 256
#: Rows (query, list) that leave a task at once.
ASKED = 4096
#: Above the rounding of float sums over unit vectors, and of similarities to 9 digits.
SLACK = 1e-5


@dataclass(frozen=True)
class Model:
    """Centres of the lists (lists x dimensions) and the codebooks of residuals (parts x values x width)."""

    centres: np.ndarray
    books: np.ndarray

    def nearest(self, units: np.ndarray) -> np.ndarray:
        return _nearest(units, self.centres)

    def rebuilt(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        residuals = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return self.centres[lists] + residuals[:, : self.centres.shape[1]]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = [np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _means(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k means of rows by Lloyd's rounds, begun at rows spread over the sample; a mean without rows stays."""
    centres = rows[np.unique(np.linspace(0, len(rows) - 1, k).astype(np.int64))].astype(np.float64)
    for _ in range(rounds):
        of = _nearest(rows, centres.astype(np.float32))
        sizes = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres.astype(np.float32)


def _units(embeddings: pd.Series, dimension: int) -> np.ndarray:
    """Vectors scaled to length 1; one that is null, without direction or of another dimension is 0, as is its similarity."""
    out = np.zeros((len(embeddings), dimension), np.float32)
    for i, v in enumerate(embeddings):
        if v is not None and len(v) == dimension:
            row = np.asarray(v, np.float64)
            length = math.sqrt(float(row @ row))
            if length > 0:
                out[i] = row / length
    return out


def fit(vectors: DataFrame, parts: int, lists: int | None = None) -> Model | None:
    """The model of a table (id, embedding); None of a table without a vector.

    There are about as many lists as the root of the number of rows (at most MOST_LISTS), in two
    levels: a root of them is fitted on the sample, and each of these is divided on its own rows. The
    sample has SAMPLE rows a list, drawn by hash of id. Groups are fitted in tasks of their own, as
    are the codebooks, one for each part of the residuals.
    """
    there = vectors.where(F.size("embedding") > 0).select("id", "embedding")
    total = there.count()
    if not total:
        return None
    dimension = len(there.first()["embedding"])
    lists = min(lists or math.ceil(math.sqrt(total)), MOST_LISTS)
    sample = materialise(there.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * lists).select("embedding"), "sample")

    def level(rows: DataFrame, k: int, of: Column) -> np.ndarray:
        def means(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"of": group["of"].iloc[0], "centre": list(_means(_units(group["embedding"], dimension), k))})

        found = rows.withColumn("of", of).groupBy("of").applyInPandas(means, "of int, centre array<float>").orderBy("of").collect()
        return np.array([r["centre"] for r in found], np.float32)

    root = math.ceil(math.sqrt(lists))
    coarse = level(sample, root, F.lit(0))

    @F.pandas_udf("int")
    def nearest(embeddings: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_units(embeddings, dimension), coarse).astype(np.int32))

    centres = level(sample, math.ceil(lists / root), nearest("embedding"))
    width = math.ceil(dimension / parts)

    def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = _cut(_units(frame["embedding"], dimension), centres, parts, width)
            for j in range(parts):
                yield pd.DataFrame({"part": j, "value": list(cut[:, j])})

    def book(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"].iloc[0], "centre": list(_means(np.stack(group["value"].to_numpy()), VALUES))})

    books = np.zeros((parts, VALUES, width), np.float32)
    filled = [0] * parts
    for r in sample.mapInPandas(residuals, "part int, value array<float>").groupBy("part").applyInPandas(book, "part int, centre array<float>").collect():
        books[r["part"], filled[r["part"]]] = r["centre"]
        filled[r["part"]] += 1
    return Model(centres, books)


def _cut(units: np.ndarray, centres: np.ndarray, parts: int, width: int) -> np.ndarray:
    residual = units - centres[_nearest(units, centres)]
    return np.pad(residual, ((0, 0), (0, parts * width - residual.shape[1]))).reshape(len(units), parts, width)


def encode(vectors: DataFrame, model: Model) -> DataFrame:
    """id, list, code (a byte a part), error (the distance between a unit vector and what its code stands for), distance from the centre."""
    given = vectors.sparkSession.sparkContext.broadcast(model)
    parts, _, width = model.books.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = given.value
        for frame in frames:
            units = _units(frame["embedding"], m.centres.shape[1])
            of = m.nearest(units)
            cut = _cut(units, m.centres, parts, width)
            codes = np.stack([_nearest(cut[:, j], m.books[j]) for j in range(parts)], axis=1).astype(np.uint8)
            error = np.linalg.norm(units - m.rebuilt(of, codes), axis=1)
            distance = np.linalg.norm(units - m.centres[of], axis=1)
            yield pd.DataFrame({"id": frame["id"], "list": of.astype(np.int32), "code": [c.tobytes() for c in codes], "error": error, "distance": distance})

    return vectors.select("id", "embedding").mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, list int, code binary, error float, distance float")


def _blocked(rows: DataFrame, size: int, key: str) -> DataFrame:
    """rows with `block`: a list's rows are dealt by hash of `key` to blocks of about `size`."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("_blocks"))
    return rows.join(counts, "list").withColumn("block", F.pmod(F.xxhash64(key), F.col("_blocks"))).drop("_blocks")


def blocks(encoded: DataFrame) -> DataFrame:
    """The index: one row a block of a list, with its ids, codes and errors."""
    rows = _blocked(encoded, ROWS, "id").groupBy("list", "block").agg(F.collect_list(F.struct("id", "code", "error")).alias("rows"))
    return rows.select("list", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"), F.col("rows.error").alias("errors"))


def _asked(queries: DataFrame, model: Model, radii: np.ndarray, probes: int | None) -> DataFrame:
    """query_id, unit, least, list: the `probes` lists of the nearest centres, or all that can hold a row of `least` similarity."""
    given = queries.sparkSession.sparkContext.broadcast(model.centres)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, len(frame), QUERIES):
                some = frame.slice(start, QUERIES)
                units = _units(some.column("embedding").to_pandas(), given.value.shape[1])
                to = units @ given.value.T
                if probes is None:
                    which = to + radii * np.linalg.norm(units, axis=1)[:, None] >= np.asarray(some.column("least"))[:, None] - SLACK
                else:
                    which = np.zeros(to.shape, bool)
                    np.put_along_axis(which, np.argsort(-to, axis=1, kind="stable")[:, :probes], True, axis=1)
                every, lists = np.nonzero(which)
                # a query has a row for each list, which are many in a large table, and leaves with its vector in each
                for first in range(0, len(every), ASKED):
                    i, of = every[first : first + ASKED], lists[first : first + ASKED]
                    at = np.arange(len(i) + 1, dtype=np.int32) * units.shape[1]
                    unit = pa.ListArray.from_arrays(at, pa.array(units[i].ravel()))
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(i)), unit, some.column("least").take(pa.array(i)), pa.array(of.astype(np.int32))], names=["query_id", "unit", "least", "list"])

    return queries.select("query_id", "embedding", "least").mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, unit array<float>, least double, list int")


def _met(asked: DataFrame, index: DataFrame, model: Model, keep: int | None, lower: bool) -> DataFrame:
    """query_id, id, score from codes, by blocks of queries and of rows that meet on their list.

    With `keep` a block gives the best rows of each query, by score or by the least that it can be; else all
    that can reach the query's `least`.
    """
    given = index.sparkSession.sparkContext.broadcast(model)
    packed = _blocked(asked, QUERIES, "query_id").groupBy("list", "block").agg(F.collect_list(F.struct("query_id", "unit", "least")).alias("asked"))
    packed = packed.select("list", F.col("asked.query_id").alias("queries"), F.col("asked.unit").alias("units"), F.col("asked.least").alias("leasts"))
    query, row = packed.schema["queries"].dataType.elementType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        parts = len(m.books)
        for frame in frames:
            for i in range(len(frame)):
                part = {name: frame.column(name)[i] for name in frame.schema.names}
                ids, queries = part["ids"].values, part["queries"].values
                codes = np.frombuffer(b"".join(part["codes"].as_py()), np.uint8).reshape(-1, parts)
                rows = m.rebuilt(np.full(len(codes), part["list"].as_py()), codes)
                units = np.array(part["units"].as_py(), np.float32)
                # a query without direction has similarity 0 to all
                error = np.linalg.norm(units, axis=1)[:, None] * np.array(part["errors"].as_py(), np.float32)
                score = units @ rows.T
                if keep is None:
                    at, of = np.nonzero(score + error >= np.array(part["leasts"].as_py())[:, None] - SLACK)
                    value = score[at, of]
                else:
                    value = score - error if lower else score
                    some = min(keep + 1, value.shape[1])  # one more, as a query may meet its own row
                    of = np.argpartition(-value, some - 1, axis=1)[:, :some]
                    value = np.take_along_axis(value, of, axis=1).ravel()
                    at, of = np.repeat(np.arange(len(units)), some), of.ravel()
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), ids.take(pa.array(of)), pa.array(value.astype(np.float64))], names=["query_id", "id", "score"])

    return packed.join(index, "list").mapInArrow(run, f"query_id {query}, id {row}, score double").where("id <> query_id")


def candidates(queries: DataFrame, vectors: DataFrame, n: int, parts: int = 32, probes: float = 8, rerank: int | None = None, lists: int | None = None) -> DataFrame:
    """query_id, id of the rows that codes don't rule out.

    With `rerank`: the best `rerank` by codes of the `probes` nearest lists, a number or (below 1) a share of
    them; vectors that don't cluster need a share. Without: a set that holds the
    n best rows. The n-th largest least score of the nearest lists is reached by n rows; so lists
    whose radius, and rows whose error, keep them below it are ruled out.
    """
    # of equal vectors only the n smallest ids can be found, or one more by a query that is among them
    vectors = vectors.select("id", "embedding").withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("_n") <= n + 1).drop("_n")
    model = fit(vectors, parts, lists)
    if model is None:
        return queries.join(vectors, F.lit(False)).select("query_id", "id") if rerank else queries.join(vectors, F.col("id") != F.col("query_id")).select("query_id", "id")
    probes = math.ceil(probes * len(model.centres)) if probes < 1 else probes
    encoded = materialise(encode(vectors, model), "codes")
    index = materialise(blocks(encoded), "blocks")
    radii = np.full(len(model.centres), -np.inf, np.float32)
    for r in encoded.groupBy("list").agg(F.max("distance").alias("radius")).collect():
        radii[r["list"]] = r["radius"]
    open_ = queries.select("query_id", "embedding", F.lit(-2.0).alias("least"))
    near = _met(_asked(open_, model, radii, probes), index, model, rerank or n, lower=not rerank)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= (rerank or n))
    if rerank:
        return near.select("query_id", "id")
    least = near.groupBy("query_id").agg(F.when(F.count("*") >= n, F.min("score")).otherwise(-2.0).alias("least"))
    known = queries.select("query_id", "embedding").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return _met(_asked(known, model, radii, None), index, model, None, lower=False).select("query_id", "id")


def quantised_top(queries: DataFrame, vectors: DataFrame, n: int, parts: int = 32, probes: float = 8, rerank: int | None = None, lists: int | None = None) -> DataFrame:
    """query_id, id, similarity, rank of the n most similar rows: vectors are read for candidates() alone.

    Equal to brute force without `rerank`; with it, as good as the codes. query_id and id are unique, not null and of
    one kind, and all vectors of one dimension; a null vector, or one without direction, has similarity 0 to all.
    Ties go to the smaller id.
    """
    pairs = materialise(candidates(queries, vectors, n, parts, probes, rerank, lists), "candidates")
    both = pairs.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").join(vectors.select("id", "embedding"), "id")
    scored = both.select("query_id", "id", F.round(F.coalesce(cosine(F.col("_q"), F.col("embedding")), F.lit(0.0)), 9).alias("similarity"))
    return top_k(scored, n, ["query_id"], "similarity", "id")
