import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from corvidex.llm import packing
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import W, brute
from tests.llm.test_quality_rules import brute as figures


def stage(spark, docs, name, tmp):
    out = str(tmp / name)
    dict(cp.STAGES)[name](spark, docs, None).write.parquet(out)
    return spark.read.parquet(out)


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = stage(spark, docs, "quality_rules", tmp_path)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    for r in docs.collect():
        n, chars, symbols, _, rep = figures(r.text)
        assert (r.doc_id in kept) == (n >= 20 and 100 * rep <= 30 * n and 100 * symbols <= 10 * chars)
    one = stage(spark, good, "near_duplicates", tmp_path)
    place = brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted({v for v in place.values()})
    safe = stage(spark, one, "secrets", tmp_path)
    assert safe.columns == docs.columns and safe.count() == one.count()
    assert not safe.where("text rlike 'AKIA[A-Z0-9]{16}' or text rlike '[0-9a-f]{24}' or n_chars <> length(text)").count()
    mixed = stage(spark, safe, "source_mix", tmp_path)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in safe.collect():
        sizes[r.source] += len(W.findall(r.text))
    for r in mixed.collect():
        taken[r.source] += len(W.findall(r.text))
    for s, want in fill(sizes).items():
        assert abs(taken[s] - want) <= 1
    packed = stage(spark, mixed, "packing", tmp_path).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in mixed.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        want.update((r.doc_id, at // 2048, zlib.crc32(np.array(ids[at : at + 2048], dtype="<u4").tobytes())) for at in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want


def test_odd_and_empty(spark, odd, none, tmp_path):
    for i, docs in enumerate((odd, none)):
        for name, f in cp.STAGES:
            out = str(tmp_path / f"{i}{name}")
            columns = docs.columns
            f(spark, docs, None).write.parquet(out)
            docs = spark.read.parquet(out)
            assert name == "packing" or docs.columns == columns
        assert i == 0 or docs.count() == 0
