import random
import tracemalloc

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.llm import token_counts as tc
from corvidex.llm.queries import op8_edit_aware_counts

C = tc.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ALPHABET = st.text(alphabet="ab  \n\t'st1²é.,\x85\xa0\x1cªß😀я", max_size=60)


def test_latin_pattern_is_the_full_one():
    for i in range(256):
        for t in (chr(i), "a" + chr(i) + "b", " " + chr(i) * 2 + " 1", "\n" + chr(i) + " x"):
            assert tc.LATIN.findall(t) == C.full.findall(t), i


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), ALPHABET), max_size=5))
def test_edits_equal_a_recount(text, edits):
    old, tc.BLOCK = tc.BLOCK, 3
    try:
        tree = tc.Tree.of(text, C)
        for start, n, new in edits:
            text = text[: min(start, len(text))] + new + text[min(start + n, len(text)) :]
            tree.edit(start, start + n, new)
            assert tree.text == text and tree.tokens == len(C.enc.encode_ordinary(text))
            assert sum(sum(x) for x, _ in tree.blocks) == len(text)
            assert tree.sums[1].tolist() == [len(text), tree.tokens] and max(len(x) for x, _ in tree.blocks) <= 4 * tc.BLOCK
    finally:
        tc.BLOCK = old


@settings(max_examples=100, deadline=None)
@given(ALPHABET.map(lambda t: t * 3))
def test_slices_are_the_whole_split(text):
    old, tc.SLICE = tc.SLICE, 4
    try:
        assert sum(C.slices(text), []) == C.pattern(text).findall(text) and max(map(len, C.slices(text)), default=0) <= 4
        lengths, counts = C.split(text)
        assert sum(lengths) == len(text) and sum(counts) == len(C.enc.encode_ordinary(text))
    finally:
        tc.SLICE = old


def test_long_pre_tokens_are_not_kept_without_bound():
    c, r = tc.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), room=1000), random.Random(1)
    for _ in range(20):
        pieces = ["".join(r.choices("abcdefgh", k=2000)) for _ in range(10)]
        assert c.counts(pieces) == [len(c.enc.encode_ordinary(p)) for p in pieces]
        assert sum(map(len, c.known)) <= 16 * 1000 + 10 * 2000


def test_a_long_text_is_counted_in_little_memory():
    """Below 20 bytes a character besides the text: its pre-tokens as strings at once take more."""
    text = " ".join(str(k % 5000) + "ab"[k % 2] for k in range(500_000))
    tc.Tree.of(text[:1000], C)
    tracemalloc.start()
    try:
        tree = tc.Tree.of(text, C)
        assert tracemalloc.get_traced_memory()[1] < 20 * len(text)
    finally:
        tracemalloc.stop()
    assert tree.tokens == len(C.enc.encode_ordinary(text))


def changed(t):
    """A text after the sample edits."""
    n = len(t)
    for s, e, new in ((3 * n // 4, 3 * n // 4 + 9, t[:24]), (n // 2, n // 2 + 17, ""), (n // 4, n // 4, " Note 2: it's new,\n")):
        t = t[:s] + new + t[e:]
    return t


def test_query(spark, sf, odd, none):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_edit_aware_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        assert r.n_tokens == len(C.enc.encode_ordinary(t))
        assert r.n_tokens_after == len(C.enc.encode_ordinary(changed(t))) and r.n_encoded < 80
    assert tc.edited_counts(odd).count() == odd.count() and tc.edited_counts(none).count() == 0


def test_later_edits_go_on_from_stored_trees(spark, odd, tmp_path):
    """Three rounds, each from the table the last one wrote: a large insertion, small edits, none; always a recount of the text."""
    big = "many new words, 12 of them\n" * 4000
    rounds = [F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit(big).alias("new"))), tc.sample_edits(F.col("text")), F.lit(None)]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    tc.trees(odd).write.parquet(str(tmp_path / "0"))
    for k, edits in enumerate(rounds):
        tc.apply_edits(spark.read.parquet(str(tmp_path / str(k))), edits).write.parquet(str(tmp_path / str(k + 1)))
        texts = {i: (t[:3] + big + t[5:], changed(t), t)[k] for i, t in texts.items()}
        for r in spark.read.parquet(str(tmp_path / str(k + 1))).collect():
            assert r.text == texts[r.doc_id] and r.n_tokens == len(C.enc.encode_ordinary(r.text))
            assert sum(tc.unpacked(r.lengths)) == len(r.text) and sum(tc.unpacked(r.counts)) == r.n_tokens
            assert (r.n_encoded < 80) if k == 1 else k == 0 or r.n_encoded == 0
