"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its lower-cased words, pairs of neighbours, and pairs with one or two words
between. They are hashed into 2^bits places. Learning keeps a rate for each coordinate and L1 drives most weights to
exactly zero, so the model is a short list of places and weights, small enough to broadcast whatever the corpus.

Learning reads at most `train_rows` labelled rows (the documented bound; a sample by hash of the id, so the same rows
whatever the partitioning); scoring reads every whole text. Labels, language, source and ids are never inputs of a
score. Nulls: a null text is empty and gets the bias alone; null labels teach nothing; several labels of an id count
as toxic if one is. A null id is held out (its text is taken as empty for the split). Without labels every score is 0.
Repeated rows are scored alike; of an id that has several texts the least one teaches. Very long texts are read whole, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, forget, text_or_empty, tidy, unused, word_hashes

TRAIN_ROWS = 16_000
BITS = 22

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """Nonzero weights of the places, ascending by place; a model without training rows scores 0."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    trained: bool = True

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.places] = self.weights
        return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct places of the text's features."""
    words = WORD.findall(text.lower())
    h = np.fromiter((word_hashes[w] for w in words), np.uint64, len(words))
    parts = [h]
    for gap, factor in ((1, _A), (2, _B), (3, _C)):
        if len(h) > gap:
            mixed = h[:-gap] * factor ^ (h[gap:] >> np.uint64(7)) * _A
            parts.append(mixed * _C)
    places = np.concatenate(parts) >> np.uint64(64 - bits)
    places = np.sort(places.astype(np.uint32))
    keep = np.ones(len(places), bool)
    keep[1:] = places[1:] != places[:-1]
    return places[keep]


def packed(places: np.ndarray) -> bytes:
    """Ascending places as their gaps, whose high bytes are mostly zero, compressed: about a third of their size."""
    gaps = np.diff(places.astype("<u4"), prepend=np.uint32(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def ftrl(rows: Sequence[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 0.7, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 3, toxic_weight: float = 3.0) -> Model:
    """FTRL-proximal with per-coordinate rates. rows: (places, label), in the order in which they teach.

    toxic_weight: how much more a toxic row counts, as these are few."""
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, bits, trained=False)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits  # the bias is a coordinate without L1

    def weights(i: np.ndarray) -> np.ndarray:
        zi, pull = z[i], np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for places, label in rows:
            i = np.append(places.astype(np.int64), bias)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (toxic_weight if label else 1.0)
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    seen = np.flatnonzero((z[:-1] > l1) | (z[:-1] < -l1))
    w = weights(seen)
    return Model(seen, w.astype(np.float32), float(weights(np.array([bias]))[0]), bits)


class _Unpacking(Sequence):
    """Rows of packed places and a label, each unpacked whenever it is asked for: the sample is held packed."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, int]:
        data, label = self.rows[k]
        return unpacked(data), label


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most train_rows labelled rows outside the held-out split.

    The ids are chosen first (a top-k by hash, reduced where it is read), so the join against all texts carries a
    side of at most train_rows rows."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most train_rows ids and labels
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # an id teaches once, however often it stands


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """Executors turn the sample into places; one task, over that bounded sample, learns; the sparse weights come back."""

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "toxic": pdf.toxic, "places": [packed(features(t, bits)) for t in pdf.text]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(i), bytes(p), int(y)) for pdf in batches for i, p, y in zip(pdf.doc_id, pdf.places, pdf.toxic, strict=True))
        order = np.random.default_rng(7).permutation(len(rows))  # ids sort by age; learning order must not
        m = ftrl(_Unpacking([rows[k][1:] for k in order]), bits)
        yield pd.DataFrame({"places": [m.places.astype("<i8").tobytes()], "weights": [m.weights.astype("<f4").tobytes()], "bias": [m.bias], "trained": [m.trained]})

    sample = training_rows(docs, labels, train_rows).mapInPandas(tidy(featurise), "doc_id bigint, toxic int, places binary")
    r = sample.repartition(1).mapInPandas(tidy(learn), "places binary, weights binary, bias double, trained boolean").collect()
    if not r:  # no partition, no row
        return ftrl([], bits)
    return Model(np.frombuffer(r[0].places, "<i8"), np.frombuffer(r[0].weights, "<f4"), r[0].bias, bits, r[0].trained)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and, at the end, toxicity (double, 0 to 1), under a name that docs doesn't have yet."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # nonzero weights only
    keep: dict = {}

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        if m.trained and "dense" not in keep:
            keep["dense"] = m.dense()
        for s in texts:
            if not m.trained:
                yield pd.Series(np.zeros(len(s)))
                continue
            margin = np.array([keep["dense"][features(t, m.bits)].sum() + m.bias for t in s], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        keep.clear()
        forget()

    return docs.withColumn(score_column(docs), probability(text_or_empty(text)))


def score_column(docs: DataFrame) -> str:
    return unused(docs, "toxicity")
