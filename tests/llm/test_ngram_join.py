import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvidex.llm import ngram_join as nj
from corvidex.llm.queries import op7_partenum_jaccard

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = W.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, pct):
    """[(id, set)] -> {id: smallest id of its component}, by union-find over all pairs that sizes allow."""
    sets = sorted(((shingles(t, k), i) for i, t in rows), key=lambda x: len(x[0]))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, (a, _) in enumerate(sets):
        for y in range(x + 1, len(sets)):
            b = sets[y][0]
            if 100 * len(a) < pct * len(b):
                break
            if a and root(x) != root(y):
                common = len(a & b)
                if 100 * common >= pct * (len(a) + len(b) - common):
                    up[root(x)] = root(y)
    least = defaultdict(lambda: 10**18)
    for x, (_, i) in enumerate(sets):
        least[root(x)] = min(least[root(x)], i)
    return {(i, len(s)): least[root(x)] for x, (s, i) in enumerate(sets)}


def family(r, words, n, top):
    base = [r.choice(words) for _ in range(r.choice((4, 12, 40, 90, 300)))]
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, top)):
            t[r.randrange(len(t))] = r.choice(words)
        yield " ".join(t)


@pytest.mark.parametrize(("k", "pct"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, k, pct):
    r = random.Random(k)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(40) for t in family(r, words, r.choice((1, 3, 12, 25)), r.choice((1, 2, 5)))]
    rows = list(enumerate(texts))
    got = {(x.doc_id, x.n_shingles): x.component_id for x in nj.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), join=nj.Join(k, pct)).collect()}
    assert got == brute(rows, k, pct)


def test_contract_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(x.doc_id, x.n_shingles): x.component_id for x in op7_partenum_jaccard(spark, sf).collect()}
    assert got == brute(rows, 3, 90)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(2)
    for join in (nj.Join(3, 90), nj.Join(5, 80)):
        for _ in range(400):
            n = int(r.integers(3, 400))
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            out = int(r.integers(0, max(1, n * (100 - join.percent) // 60)))
            b = np.unique(np.concatenate([a[out:], r.integers(0, 2**63, int(r.integers(0, out + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= join.percent * (len(a) + len(b) - common) and len(a) != common:
                shared = np.intersect1d(nj.signatures(a, join), nj.signatures(b, join)) & nj.BAND_BITS
                # what may still go by popularity leaves one, in some band of both
                assert any((shared == x).sum() > join.extra(int(x)) for x in set(shared.tolist()))
                flips = np.bitwise_count((nj.sketch(a) ^ nj.sketch(b)).view(np.uint64)).sum()
                assert (100 + join.percent) * flips <= (100 - join.percent) * (len(a) + len(b))


def test_odd_rows(spark, odd, none):
    rows = nj.components(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.n_shingles == 0:
            assert r.component_id == r.doc_id
    kept = nj.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert nj.components(none).count() == 0 and nj.one_of_each(none).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Repeated ids with different texts, and null ids: every component keeps one row, no text loses its last copy."""
    def prose(k):
        return " ".join(f"{k}word{i}" for i in range(40))

    rows = [(1, prose("a")), (5, prose("a")), (5, prose("b")), (7, prose("c")), (7, prose("d")), (7, prose("d")), (8, prose("d"))]
    rows += [(None, prose("e")), (None, prose("e")), (None, prose("f")), (2, prose("f")), (None, prose("g")), (9, prose("h") + " tail"), (9, prose("h"))]
    rows += [(None, "x"), (None, None), (6, "y"), (6, "y"), (6, "z"), (3, None)]
    kept = nj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    long = Counter((r.doc_id, r.text.split()[0][0]) for r in kept if r.text and len(r.text) > 5)
    assert long == Counter([(1, "a"), (5, "b"), (7, "c"), (7, "d"), (None, "e"), (2, "f"), (None, "g"), (9, "h")])
    assert Counter((r.doc_id, r.text) for r in kept if not r.text or len(r.text) <= 5) == Counter([(None, "x"), (None, None), (6, "y"), (6, "z"), (3, None)])
