"""Hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features are word n-grams (n = 1, 2), hashed into 2**20 cells, over two readings
of each word: its lower-case form and its shape (runs of lower case, upper case,
digits; marks kept), so that form generalises to unseen words. A document is the
unit-length vector of 1 + ln(count); its score is the sparse dot product through a
sigmoid. The model (one float a cell, 4 MB) is the only thing broadcast.

Training takes at most ``MAX_ROWS`` labelled rows (those with the smallest id
hash), whatever the corpus; scoring reads every whole text.

Defined cases: null and empty texts have no features and score the intercept;
without labelled rows every score is 0.5; labels of absent documents are ignored;
repeated rows are scored alike; if a document has several labels the largest counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvidex.plans.shared import arrow_batches, as_text

BITS = 20
MAX_ROWS = 6000
EPOCHS = 2
SEED = "quality-1"
_RUNS = ((re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[0-9]+"), "0"))


class Hasher:
    """Words to cells; shapes and cells of words are remembered up to ``room`` words."""

    def __init__(self, bits: int = BITS, room: int = 300_000):
        self.mask, self.room = (1 << bits) - 1, room
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        shape = w
        for pattern, by in _RUNS:
            shape = pattern.sub(by, shape)
        return zlib.crc32(w.lower().encode()), zlib.crc32(shape.encode(), 7)

    def cells(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Cells and weights of unit length."""
        words = text.split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.room:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.word(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        if len(known) > self.room:
            known.clear()
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        same = np.where(h[:-1, 0] == h[1:, 0], np.uint64(12345), np.uint64(54321))
        mixed = np.concatenate([h.ravel() * np.uint64(0xC2B2AE3D27D4EB4F), pairs.ravel(), same * np.uint64(0xC2B2AE3D27D4EB4F)])
        cell, n = np.unique((mixed >> np.uint64(29)).astype(np.int64) & self.mask, return_counts=True)
        x = 1 + np.log(n)
        return cell, x / np.sqrt((x * x).sum())


class Ftrl:
    """FTRL-proximal, one coordinate a cell and an intercept in the last."""

    def __init__(self, cells: int = 1 << BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros(cells + 1), np.zeros(cells + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, **options: float) -> np.ndarray:
    model = Ftrl(1 << bits, **options)
    r = np.random.default_rng(1)
    for _ in range(epochs):
        for k in r.permutation(len(rows)):
            i, x, y = rows[k]
            model.update(np.append(i, 1 << bits), np.append(x, 1.0), y)
    return model.weights(slice(None)).astype(np.float32)


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: str, *, doc_id: str = "doc_id", text: str = "text", rows: int = MAX_ROWS, seed: str = SEED) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled ids, those with the smallest seeded hash: a bounded broadcast."""
    picked = (
        labels.where(train & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id")
        .limit(rows)
    )
    return docs.select(F.col(doc_id).alias("_id"), as_text(text).alias("text")).join(F.broadcast(picked), "_id")


def train(docs: DataFrame, labels: DataFrame, where: Column, *, label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from a bounded sample; texts become cells on the executors, equal texts count once."""

    @arrow_udf(T.StructType([T.StructField("cells", T.BinaryType()), T.StructField("x", T.BinaryType())]))
    def features(text: pa.Array) -> pa.Array:
        h = Hasher()
        made = [h.cells(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([c.astype(np.int32).tobytes() for c, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], ["cells", "x"]
        )

    arrow_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, where, label, rows=max_rows).select("_id", "y", F.xxhash64("text").alias("same"), features("text").alias("f")).collect()
    once = {r["same"]: r for r in sorted(rows, key=lambda r: r["_id"], reverse=True)}
    data = [(np.frombuffer(r["f"]["cells"], np.int32).astype(np.int64), np.frombuffer(r["f"]["x"], np.float32).astype(np.float64), r["y"]) for r in sorted(once.values(), key=lambda r: r["_id"])]
    return fit(data)


_HASHER: list[Hasher] = []


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) of every whole text."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        if not _HASHER:
            _HASHER.append(Hasher())
        w = model.value
        logits = np.full(len(text), float(w[-1]))
        for k, t in enumerate(text.to_pylist()):
            i, x = _HASHER[0].cells(t)
            logits[k] += float(w[i] @ x)
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return docs.withColumn(out, scored(as_text(text)))
