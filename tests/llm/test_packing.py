import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvidex.llm import packing
from corvidex.llm.queries import op4_best_fit_packing


def check(docs, rows):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id if r.doc_id is not None else -1, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = rows.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by), -(-sum(r.length for r in got) // 2048)


def test_round_trip(spark, sf, odd, none):
    n, least = check(spark.read.parquet(f"{sf}/documents.parquet"), op4_best_fit_packing(spark, sf))
    assert n <= least + 2
    check(odd, packing.pack(odd))
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200))
def test_plan_uses_every_length_once(lengths):
    have = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, dtype=int)
    plans = packing.plan_patterns(have, 32)
    used = np.zeros(33, dtype=int)
    for kinds, times in plans:
        assert times > 0 and sum(x * t for x, t in kinds) <= 32
        for x, t in kinds:
            used[x] += t * times
    assert (used == have).all()
    assert len(plans) <= 64


def test_encoder_is_exact_on_odd_text():
    path = packing.tokenizer_path()
    e = packing.WordEncoder(path, room=50)
    for t in ("It's the DOG's, isn't? #1 3.14", "ÀÉ ﬁń ΑΣ ς", "a b\x1cc d", "<|endoftext|> x<|startoftext|>y", "naïve.,; ééé!!! ñ... “q”", "é! ́ x"):
        assert e(t) == e.whole(t), t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=14), st.integers(1, 16), st.lists(st.integers(0, 13), max_size=8))
def test_sum_index_finds_every_complement(lengths, first, gone):
    """As counts fall, a single, pair or triple is found whenever brute force finds one, and it is one."""
    have = np.bincount(lengths, minlength=17)
    index = packing.SumIndex(have)
    for k in [*gone, None]:
        for lead in (first, 1, 16):
            if have[lead]:
                rest = [x for x in range(1, 17) for _ in range(int(have[x]) - (x == lead))]
                possible = 16 == lead or any(sum(c) == 16 - lead for n in (1, 2, 3) for c in combinations(rest, n))
                got = index.complement(lead, 16)
                assert (got is not None) == possible
                if got:
                    assert got[0] == lead and sum(got) == 16 and index.fits(got)
        if k is not None and k < len(lengths) and have[lengths[k]]:
            have[lengths[k]] -= 1
