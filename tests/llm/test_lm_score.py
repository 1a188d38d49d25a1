from collections import Counter
from math import log

import numpy as np

from corvidex.llm import lm_score as lm


def models(rows, wanted):
    """(P(w), P(w | u) as functions, share) of target and background by dictionaries; None is the end of a document."""
    words = {i: (t or "").lower().split() for i, t in rows}
    vocabulary = {w for ws in words.values() for w in ws}
    target = [words[i] for i in words if i in wanted]
    out = []
    size = [sum(len(ws) + bool(ws) for ws in part) for part in (target, list(words.values()))]
    for part, share in ((target, 1.0), (list(words.values()), size[0] / size[1] if size[1] else 0.0)):
        uni = Counter(w for ws in part for w in ws)
        uni[None] = sum(bool(ws) for ws in part)
        two = Counter(p for ws in part if ws for p in zip(ws, [*ws[1:], None], strict=True))
        events = sum(uni.values())

        def single(w, uni=uni, share=share, events=events):
            return (share * uni[w] + 1) / (share * events + len(vocabulary) + 1)

        def after(w, u, uni=uni, two=two, share=share, single=single):
            return (share * two[u, w] + lm.MU * single(w)) / (share * uni[u] + lm.MU)

        out.append((single, after))
    return words, vocabulary, out


def brute(rows, wanted):
    words, _, (target, background) = models(rows, wanted)

    def loss(ws, model):
        return -sum(log(model[1](w, u) if u is not None else model[0](w)) for u, w in zip([None, *ws], ws, strict=False)) / max(len(ws), 1)

    return {i: (len(ws), loss(ws, target), loss(ws, background)) for i, ws in words.items()}


def same(got, want):
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0]
        assert abs(r.target_loss - want[r.doc_id][1]) < 1e-9 and abs(r.background_loss - want[r.doc_id][2]) < 1e-9
        assert abs(r.difference - (want[r.doc_id][1] - want[r.doc_id][2])) < 1e-9


ROWS = [(i, t) for i, t in enumerate(["the cat sat on The mat", "the dog sat", "a a a a b", None, "", "cat cat the zebra", "the", "x  the\n"])]


def test_every_history_sums_to_one():
    _, vocabulary, both = models(ROWS, {0, 1})
    for single, after in both:
        assert abs(sum(map(single, [*vocabulary, None])) - 1) < 1e-12
        for u in vocabulary:
            assert abs(sum(after(w, u) for w in [*vocabulary, None]) - 1) < 1e-12


def test_against_brute_force(spark, odd, none):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = spark.createDataFrame([(0,), (1,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, target).collect()}
    same(got.values(), brute(ROWS, {0, 1}))
    assert got[1].difference < got[2].difference
    assert all(r.difference == 0 for r in lm.cross_entropy_difference(docs, target.limit(0)).collect())
    assert lm.cross_entropy_difference(odd, target).count() == odd.count()
    assert lm.cross_entropy_difference(none, target.limit(0)).count() == 0


def test_many_words_over_several_blocks(spark):
    """More than 2^16 words: rare words and pairs keep their own counts, over several blocks and key ranges."""
    rows = [(0, "rare1 rare2 rare1 rare2"), (1, "rare3 rare4 rare3 rare9"), (2, "rare2 rare1 w7 w8"), (3, None)]
    rows += [(10 + i, " ".join(f"w{(i * 700 + j) * (1 + i % 2) % 90000}" for j in range(700))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(0,), (11,)], "doc_id long")
    want = brute(rows, {0, 11})
    for block in (lm.BLOCK, 20000):
        same(lm.cross_entropy_difference(docs, target, block=block).collect(), want)


def test_whole_table(spark, sf):
    """Every document of the small tables against dictionaries."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    rows = [(r.doc_id, (r.text or "").translate({c: c + 32 for c in range(65, 91)})) for r in docs.collect()]
    ascii_only = [(i, t) for i, t in rows if t.isascii()]
    keep = spark.createDataFrame([(i,) for i, _ in ascii_only], "doc_id long")
    same(lm.cross_entropy_difference(docs.join(keep, "doc_id"), target).collect(), brute(ascii_only, {r.doc_id for r in target.collect()}))


def test_empty_texts_alone(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert {(r.n_tokens, r.difference) for r in lm.cross_entropy_difference(docs, docs.select("doc_id")).collect()} == {(0, 0.0)}


def test_planes_round_trip():
    x = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (lm.from_planes(lm.planes(x), np.uint64) == x).all()
    keys = np.unique(x)
    assert (np.diff(lm.ranges_of(keys, 37)) >= 0).all() and lm.ranges_of(keys, 37).max() < 37
