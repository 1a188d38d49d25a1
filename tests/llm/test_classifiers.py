import math
import random
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvidex.llm import quality_clf, toxicity
from corvidex.llm.queries import op1_factorization_toxicity, op9_ftrl_quality


def labels_of(spark, sf, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def held_out(rows, labels, m, k):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) and 0 <= r.score <= 1 for r in rows)
    return [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1_factorization_toxicity(spark, sf).collect()
    assert len(rows) == 10000
    got = held_out(rows, labels_of(spark, sf, "toxic"), 3, 1)
    assert auc([x[:2] for x in got]) > 0.88
    assert sum(p for _, y, p in got if not y) / sum(not y for _, y, _ in got) < 0.02
    assert sum(p for _, y, p in got if y) / sum(y for _, y, _ in got) > 0.75


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = op9_ftrl_quality(spark, sf).collect()
    got = held_out(rows, labels_of(spark, sf, "quality"), 5, 0)
    assert auc([x[:2] for x in got]) > 0.98
    assert np.mean([y == p for _, y, p in got]) > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, 0), (5, 0, 0), (777, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        m = toxicity.train(docs, labels, F.lit(True))
        w = quality_clf.train(docs, labels, F.lit(True))
        for out in (toxicity.score(docs, m), quality_clf.score(docs, w)):
            rows = out.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    m = toxicity.train(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd, m).collect()} == {0.5}


def test_machine_learns_a_pair():
    """Two terms that are toxic only together."""
    r = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *r.integers(1000, 4_000_000, 12).tolist()})))
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y), epochs=20)
    at = {int(c): i for i, c in enumerate(m.cells)}
    i = lambda *c: np.array([at[x] for x in c], dtype=np.int64)
    assert m.logit(i(1, 2)) > 2 and m.logit(i(1)) < 0 and m.logit(i(2)) < 0


def cells_of(texts):
    return [np.array(sorted({c for w in toxicity.words_of(t) for c in toxicity.term_cells(w)}), dtype=np.int64) for t in texts]


def together(n, seed, vocabulary):
    """Texts in which two words are toxic only together; each is as common in clean as in toxic texts."""
    r, out = random.Random(seed), []
    for _ in range(n):
        kind = r.choice(("both", "one", "one", "other", "other", "none", "none", "none", "none"))
        words = {*r.sample(vocabulary, 60), *{"both": ("schurke", "gemeinde"), "one": ("schurke",), "other": ("gemeinde",), "none": ()}[kind]}
        out.append((kind, " ".join(words), int(r.random() < {"both": 0.93, "none": 0.3}.get(kind, 0))))
    return out


def test_pairs_matter_where_single_terms_say_nothing():
    """Held out, the machine finds what a linear model refitted on the same rows cannot."""
    r = random.Random(0)
    vocabulary = ["".join(r.choices(string.ascii_lowercase, k=6)) for _ in range(600)]
    train, test = together(2500, 1, vocabulary), together(1500, 2, vocabulary)
    rows, y = cells_of(t for _, t, _ in train), np.array([t for *_, t in train])
    result = {}
    for factors in (toxicity.FACTORS, 0):
        m = toxicity.fit(rows, y, factors=factors)
        p = {t: score_by_loops(m, t) for _, t, _ in test}
        result[factors] = auc([(p[t], v) for _, t, v in test]), np.mean([p[t] >= 0.7 for k, t, _ in test if k == "both"]), np.mean([p[t] >= 0.7 for k, t, _ in test if k != "both"])
    assert result[8][0] > 0.85 and result[8][1] > 0.95 and result[8][2] < 0.01
    assert result[0][0] < 0.7 and result[0][1] < 0.1


def score_by_loops(m, text):
    """Every linear weight and the product of every pair of known terms, one by one."""
    at = {int(c): i for i, c in enumerate(m.cells)}
    i = sorted({at[c] for w in toxicity.words_of(text) for c in toxicity.term_cells(w) if c in at})
    z = m.w0 + sum(m.w[a] for a in i) + sum(float(m.v[a] @ m.v[b]) for n, a in enumerate(i) for b in i[n + 1 :])
    return 1 / (1 + math.exp(-max(-35, min(35, z))))


def quality_by_loops(weights, text):
    """The sparse dot product over counted n-grams in a dictionary."""
    words, odd = text.split(), 0xC2B2AE3D27D4EB4F
    h = quality_clf.Hasher()
    both = [h.word(w) for w in words]
    grams = [x * odd for pair in both for x in pair]
    for a, b in zip(both, both[1:]):
        grams += [(a[k] * 0x9E3779B1 + b[k] * 0x85EBCA77 + 1) * odd for k in (0, 1)] + [(12345 if a[0] == b[0] else 54321) * odd]
    n = Counter((g % 2**64 >> 29) % (1 << quality_clf.BITS) for g in grams)
    norm = math.sqrt(sum((1 + math.log(c)) ** 2 for c in n.values())) or 1
    z = float(weights[-1]) + sum(float(weights[g]) * (1 + math.log(c)) / norm for g, c in n.items())
    return 1 / (1 + math.exp(-z))


def test_scores_against_plain_loops(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    m, w = toxicity.train(docs, labels, F.lit(True)), quality_clf.train(docs, labels, F.lit(True))
    assert len(m.cells) and np.abs(w).max() > 0
    for r in toxicity.score(docs, m).collect():
        assert abs(r.score - score_by_loops(m, r.text or "")) < 1e-9
    for r in quality_clf.score(docs, w).collect():
        assert abs(r.score - quality_by_loops(w, r.text or "")) < 1e-5
