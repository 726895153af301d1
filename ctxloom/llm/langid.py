"""Language identification by hierarchical discrimination.

A text's family is predicted first; one-versus-one linear support vector machines then separate the
languages of that family. Features are hashed byte n-grams (1 to 3) of the whole text, lower-case
and with every ASCII non-letter as a blank, as square roots of counts, scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextBlock, crc_fold, keep_rows, mix, slices

#: Families of ISO 639-1 codes; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "yue zh",
}

#: Rows of each language that the machines are fitted on, about; a bound, whatever the table's size.
SAMPLE_PER_LANGUAGE = 600
FOLDS, DIM = 5, 1 << 13
#: keep() keeps a document whose language is this probable; below it, neither family nor language is clear.
MIN_SCORE = 0.3
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _FOLD[_b] = _b
_GRAM = [mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 7)) for k in range(3)]


def features(block: TextBlock) -> np.ndarray:
    """A row of DIM figures for each text."""
    data, n = _FOLD[block.data], len(block.data)
    doc = np.repeat(np.arange(block.n_docs), np.diff(block.doc_at))
    counts = np.zeros(block.n_docs * DIM, np.float32)
    code = np.zeros(n, np.uint64)
    for k in range(3):
        code = code[: n - k] + _GRAM[k][data[k:]]
        here = doc[: n - k]
        whole = here == doc[k:]
        slot = (mix(code[whole] + np.uint64(k)) >> np.uint64(64 - 13)).astype(np.int64)
        counts += np.bincount(here[whole] * DIM + slot, minlength=len(counts)).astype(np.float32)
    out = np.sqrt(counts.reshape(block.n_docs, DIM))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Machine:
    """One-versus-one machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # DIM x pairs
    bias: np.ndarray
    slope: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """rows x classes: the least probable of each class's duels."""
        out = np.ones((len(x), len(self.classes)))
        if self.pairs:
            first = 1 / (1 + np.exp(-np.clip((x @ self.weights + self.bias) * self.slope, -30, 30)))
            for k, (i, j) in enumerate(self.pairs):
                out[:, i] = np.minimum(out[:, i], first[:, k])
                out[:, j] = np.minimum(out[:, j], 1 - first[:, k])
        return out


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """A linear machine with squared hinge loss (y is -1 or 1, classes weigh alike), by accelerated descent."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    w, v, b, c = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * y * weight
        new_w, new_b = v - 0.4 * (penalty * v - 2 * (slack @ x)), c + 0.4 * 2 * float(slack.sum())
        pull = t / (t + 3)
        v, c = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    margin = y * (x @ w + b)
    slopes = np.array([1.0, 2, 3, 4, 6, 8, 12])
    loss = [(weight * np.log1p(np.exp(-np.clip(s * margin, -30, 30)))).sum() for s in slopes]
    return w, b, float(slopes[int(np.argmin(loss))])


def _fit(x: np.ndarray, labels: list[str]) -> Machine:
    classes, labels = sorted(set(labels)), np.array(labels)
    pairs, fitted = list(combinations(range(len(classes)), 2)), []
    for i, j in pairs:
        rows = (labels == classes[i]) | (labels == classes[j])
        fitted.append(_svm(x[rows], np.where(labels[rows] == classes[i], 1, -1).astype(np.float32)))
    w, b, s = (np.array(v, np.float32) for v in zip(*fitted, strict=True)) if fitted else (np.zeros((0, DIM), np.float32),) * 3
    return Machine(classes, pairs, w.T, b, s)


class Identifier:
    """Families, then the languages of each."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]) -> None:
        of = {code: family for family, codes in families.items() for code in codes.split()}
        family = [of.get(lang, lang) for lang in langs]
        self.families = _fit(x, family) if langs else None
        self.within = {f: _fit(x[[i for i, g in enumerate(family) if g == f]], [lang for lang, g in zip(langs, family, strict=True) if g == f]) for f in set(family)}

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        block = TextBlock(texts)
        letters = block.per_doc((_FOLD[block.data] != 0x20) & (block.data < 0x80)) > 0
        for i in np.flatnonzero(~letters & (np.diff(block.doc_at) > 0)):
            letters[i] = any(x.isalpha() for x in texts[int(i)].as_py())
        langs, score = [UNDETERMINED] * block.n_docs, np.zeros(block.n_docs)
        if self.families is None:
            return langs, score
        x = features(block)
        p = self.families.probabilities(x)
        best = p.argmax(1)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero((best == f) & letters)
            if len(rows):
                q = self.within[name].probabilities(x[rows])
                for row, k in zip(rows, q.argmax(1), strict=True):
                    langs[row] = self.within[name].classes[k]
                score[rows] = p[rows, f] * q.max(1)
        return langs, score


def learn(docs: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE) -> Identifier:
    """Fit on a bounded sample: of each language about `per_language` of the training rows, by a hash of doc_id."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != 0))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return Identifier(np.zeros((0, DIM), np.float32), [], families)
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / count)).otherwise(share)
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def sparse(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(frames, 1):
            x = features(TextBlock(part.column(1)))
            at = [np.flatnonzero(row) for row in x]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.int16) for i in at], pa.list_(pa.int16())), pa.array([row[i] for row, i in zip(x, at, strict=True)], pa.list_(pa.float32()))], names=["lang", "at", "value"])

    rows = sample.mapInArrow(sparse, "lang string, at array<smallint>, value array<float>").toArrow()
    x = np.zeros((rows.num_rows, DIM), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    return Identifier(x, rows["lang"].to_pylist(), families)


def identify(docs: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Only text decides a prediction. Null texts and texts without a letter are `und` with score 0;
    if no row has a language to learn from, all are. A null doc_id is not held out. Repeated rows are predicted each for itself.
    Of classes that tie the first in alphabetical order is taken.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, families, per_language))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(frames, 2):
            langs, score = model.value.predict(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is determined with `min_score` at least, with all their columns.

    Null texts and texts without a letter go; if no row has a language to learn from, all go.
    Each of several equal rows is kept or goes for itself.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs))

    def sure(texts: pa.Array) -> np.ndarray:
        langs, score = model.value.predict(texts)
        return (np.array(langs) != UNDETERMINED) & (score >= min_score)

    return keep_rows(docs, sure)
