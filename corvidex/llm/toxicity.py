"""Toxicity by a factorisation machine over hashed terms.

The score of a document with the set S of known terms is
``w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)`` through a sigmoid: linear
weights plus learned weights of every pair of terms, in time linear in |S|.

Terms are lower-case words and their prefixes of four to six letters (inflected
insults share a stem), hashed into 2**22 cells. Two screens choose at most ``MAX_TERMS``
of them, so the model is a few hundred kilobytes whatever the corpus: cells that differ
between the classes beyond chance on their own, and pairs of words that do so together,
far beyond what either does alone (an insult beside the mention of a group). The second
kind enters the machine however neutral its words are, with a pair weight to start from.

Training takes at most ``MAX_ROWS`` labelled rows (those with the smallest id
hash); scoring reads every whole text, presence of a term counting alike in short
and long ones.

Defined cases: null and empty texts score the intercept; without labelled rows all
scores are 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvidex.llm.quality_clf import labelled_sample
from corvidex.plans.shared import arrow_batches, as_text

BITS = 22
MAX_ROWS = 8000
MAX_TERMS = 4096
FACTORS = 8
EPOCHS = 12
#: Words of a training text, rarest first, whose pairs are counted; bounds the pair screen, which only training rows see.
PAIR_WORDS = 400
MAX_PAIRS = 64
#: Expected number of screened terms that differ between the classes by chance alone.
CHANCE = 1e-3
SEED = "toxic-1"
_WORD = re.compile(r"[^\W\d_]+")


def term_cells(word: str) -> tuple[int, ...]:
    """Cells of a lower-case word: itself (even) and its prefixes of 4, 5 and 6 letters where it is longer (odd)."""
    room = (1 << BITS) - 2
    return (zlib.crc32(("=" + word).encode()) & room, *(zlib.crc32(("^" + word[:n]).encode()) & room | 1 for n in (4, 5, 6) if len(word) > n))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass(frozen=True)
class Machine:
    """cells: sorted known cells; w and v: their linear and pair weights; w0: the intercept."""

    cells: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, i: np.ndarray) -> float:
        if not len(i):
            return self.w0
        s = self.v[i]
        return float(self.w0 + self.w[i].sum() + 0.5 * ((s.sum(0) ** 2).sum() - (s * s).sum()))


def families(rows: list[np.ndarray], hashes: int = 5, share: int = 3, rare: int = 64) -> np.ndarray:
    """Indices of one row of each family of near copies, which would otherwise pass for independent evidence.

    Rows agreeing in ``share`` of ``hashes`` min-hashes over rare cells are of one family.
    """
    if not rows:
        return np.empty(0, np.int64)
    found, n = np.unique(np.concatenate(rows), return_counts=True)
    seldom = np.zeros(1 << BITS, dtype=bool)
    seldom[found[n <= rare]] = True
    odd = np.random.default_rng(3).integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: list[dict[int, int]] = [{} for _ in range(hashes)]
    kept = []
    for k, x in enumerate(rows):
        x = x[seldom[x]].astype(np.uint64)
        if len(x):
            low = [int((x * o).min()) for o in odd]
            met = [s[v] for s, v in zip(seen, low, strict=True) if v in s]
            if met and max(map(met.count, set(met))) >= share:
                continue
            for s, v in zip(seen, low, strict=True):
                s.setdefault(v, k)
        kept.append(k)
    return np.array(kept)


def evidence(pos: np.ndarray, n: np.ndarray, p: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of the 2x2 tables of presence (``n`` texts, ``pos`` of them toxic) and class (``p`` of ``total`` toxic)."""
    neg, q = n - pos, total - p

    def part(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9))

    return 2 * (part(pos, n * p / total) + part(neg, n * q / total) + part(p - pos, (total - n) * p / total) + part(q - neg, (total - n) * q / total))


def odds_of(pos: np.ndarray, n: np.ndarray, p: int, total: int) -> np.ndarray:
    return np.log((pos + 0.5) / (p + 1)) - np.log((n - pos + 0.5) / (total - p + 1))


def screened(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that differ between the classes beyond chance, and their log odds.

    By the log-likelihood ratio of the 2x2 table against a bound for as many tests
    as there are cells; the strongest first up to MAX_TERMS; sorted by cell.
    """
    if not rows or not 0 < y.sum() < len(y):
        return np.empty(0, np.int64), np.empty(0)
    cell = np.concatenate(rows)
    hit = np.repeat(y, [len(r) for r in rows])
    found, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    pos = np.bincount(at, weights=hit, minlength=len(found))
    g2 = evidence(pos, n, y.sum(), len(y))
    good = np.flatnonzero(g2 >= 2 * np.log(len(found) / CHANCE))
    good = np.sort(good[np.lexsort((found[good], -g2[good]))[:MAX_TERMS]])
    return found[good], odds_of(pos, n, y.sum(), len(y))[good]


def joint(rows: list[np.ndarray], y: np.ndarray, least: int = 8, share: float = 0.5) -> list[tuple[int, int, float]]:
    """(cell, cell, log odds) of pairs of words that are toxic together: far beyond chance and beyond four times what either shows alone.

    Words of ``least`` texts or more and of a ``share`` of them at most. Pairs of toxic texts are first counted in a table
    of hashed counters, which never counts too few; only those that may reach ``least`` are counted by name.
    """
    p, total = int(y.sum()), len(y)
    if not rows or not 0 < p < total:
        return []
    found, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    pos = np.bincount(at, weights=np.repeat(y, [len(r) for r in rows]), minlength=len(found))
    alone = evidence(pos, n, p, total)
    usable = (found % 2 == 0) & (n >= least) & (n <= max(share * total, least))
    count = np.zeros(1 << BITS, np.int32)
    count[found[usable]] = n[usable]

    def pairs(x: np.ndarray) -> np.ndarray:
        x = x[count[x] > 0]
        x = np.sort(x[np.lexsort((x, count[x]))[:PAIR_WORDS]])
        i, j = np.triu_indices(len(x), 1)
        return x[i] << BITS | x[j]

    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)

    table, tested = np.zeros(1 << 24, np.int32), 0
    toxic = [x for x, t in zip(rows, y, strict=True) if t]
    for x in toxic:
        key = pairs(x)
        np.add.at(table, slot(key), 1)
        tested += len(key)
    named = [key[table[slot(key)] >= least] for key in map(pairs, toxic)]
    key, hits = np.unique(np.concatenate(named), return_counts=True)
    key, hits = key[hits >= least], hits[hits >= least]
    both = np.zeros(len(key), np.int64)
    for x in rows if len(key) else ():
        own = pairs(x)
        where = np.minimum(np.searchsorted(key, own), len(key) - 1)
        both[where[key[where] == own]] += 1
    g2 = evidence(hits, both, p, total)
    a, b = key >> BITS, key & ((1 << BITS) - 1)
    own = np.maximum(alone[np.searchsorted(found, a)], alone[np.searchsorted(found, b)]) if len(key) else np.empty(0)
    odds = odds_of(hits, both, p, total)
    good = np.flatnonzero((g2 >= 2 * np.log(max(tested, 1) / CHANCE)) & (g2 >= 4 * own) & (odds > 0))
    good = good[np.lexsort((key[good], -g2[good]))[:MAX_PAIRS]]
    return [(int(a[k]), int(b[k]), float(odds[k])) for k in good]


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, l2: float = 1e-3, l2_pairs: float = 1e-2) -> Machine:
    """AdaGrad on the log loss from the log odds of terms and pairs on, so that one strong term alone counts; a fixed seed, so reruns agree. Without factors the model is linear."""
    own = families(rows)
    rows, y = [rows[i] for i in own], y[own]
    cells, odds = screened(rows, y)
    pairs = joint(rows, y) if factors else []
    more = np.setdiff1d(np.array([c for a, b, _ in pairs for c in (a, b)], np.int64), cells)[: MAX_TERMS - len(cells)]
    cells, odds = np.concatenate([cells, more]), np.concatenate([odds, np.zeros(len(more))])
    order = np.argsort(cells)
    cells, odds = cells[order], odds[order]
    r = np.random.default_rng(1)
    k = len(cells)
    w, v, w0 = odds.copy(), r.normal(0, 0.01, (k, factors)), 0.0
    place = {int(c): i for i, c in enumerate(cells)}
    for a, b, s in pairs:
        if a in place and b in place:
            i, j = place[a], place[b]
            f = int(np.argmin(np.abs(v[i]) + np.abs(v[j])))  # a factor that neither uses yet
            v[i, f] = v[j, f] = min(s, 4.0) ** 0.5
    gw, gv, g0 = np.full(k, 1e-6), np.full((k, factors), 1e-6), 1e-6
    at = np.full(1 << BITS, -1, dtype=np.int32)
    at[cells] = np.arange(k)
    known = [i[i >= 0] for i in (at[x] for x in rows)]
    if len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        w0 = float(np.log(share / (1 - share)))
    for _ in range(epochs if k else 0):
        for j in r.permutation(len(rows)):
            i = known[j]
            s = v[i]
            total = s.sum(0)
            p = 1 / (1 + np.exp(-np.clip(w0 + w[i].sum() + 0.5 * ((total * total).sum() - (s * s).sum()), -35, 35)))
            e = p - y[j]
            g0 += e * e
            w0 -= rate * e / np.sqrt(g0 + 1)
            if len(i):
                dw = e + l2 * w[i]
                gw[i] += dw * dw
                w[i] -= rate * dw / np.sqrt(gw[i])
                dv = e * (total - s) + l2_pairs * s
                gv[i] += dv * dv
                v[i] -= rate * dv / np.sqrt(gv[i])
    return Machine(cells, w0, w, v)


def train(docs: DataFrame, labels: DataFrame, where: Column, *, label: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """A machine from a bounded sample; texts become sets of cells on the executors, equal texts count once."""

    @arrow_udf(T.BinaryType())
    def features(text: pa.Array) -> pa.Array:
        return pa.array([np.array(sorted({c for w in words_of(t) for c in term_cells(w)}), dtype=np.int32).tobytes() for t in text.to_pylist()], pa.binary())

    arrow_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, where, label, rows=max_rows, seed=SEED).select("_id", "y", F.xxhash64("text").alias("same"), features("text").alias("f")).collect()
    once = {r["same"]: r for r in sorted(rows, key=lambda r: r["_id"], reverse=True)}
    kept = sorted(once.values(), key=lambda r: r["_id"])
    return fit([np.frombuffer(r["f"], np.int32).astype(np.int64) for r in kept], np.array([r["y"] for r in kept], dtype=np.int64))


class Scorer:
    """Scores texts; the known terms of a word are remembered up to ``room`` words."""

    def __init__(self, machine: Machine, room: int = 400_000):
        self.m, self.room = machine, room
        self.at = {int(c): i for i, c in enumerate(machine.cells)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        words, known = words_of(text), self.known
        for w in words.difference(known):
            known[w] = tuple(self.at[c] for c in term_cells(w) if c in self.at)
        i = {x for w in words for x in known[w]}
        if len(known) > self.room:
            known.clear()
        return self.m.logit(np.array(sorted(i), dtype=np.int64))


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, machine: Machine, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) of every whole text."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    number = model._jbroadcast.id()

    @arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        if number not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[number] = Scorer(model.value)
        logits = np.array([_SCORERS[number](t) for t in text.to_pylist()], dtype=np.float64)
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))

    return docs.withColumn(out, scored(as_text(text)))
