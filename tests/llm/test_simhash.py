import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from corvidex.llm import simhash
from corvidex.llm.queries import op5_simhash_fingerprints


def edit(texts):
    out = []
    for i, t in enumerate(texts):
        h = len(t) // 2
        out.append(t[: len(t) - h] + texts[(i + 1) % len(texts)][:h])
    return out


def test_contract(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    texts = [r.text or "" for r in docs]
    rows = sorted(op5_simhash_fingerprints(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs]
    by_text = {}
    for r, t, e in zip(rows, texts, edit(texts), strict=True):
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    fp = [int(r.fingerprint, 16) for r in rows]
    for i, r in enumerate(rows):
        assert abs(r.near_next - (1 - (fp[i] ^ fp[(i + 1) % len(fp)]).bit_count() / 64)) < 1e-12
        assert abs(r.near_edited - (1 - (fp[i] ^ int(r.edited_fingerprint, 16)).bit_count() / 64)) < 1e-12
        want = sum((fp[i] ^ y).bit_count() <= 3 for j, y in enumerate(fp) if j != i) if r.doc_id % 100 == 0 else None
        assert r.n_near == want
    far = [r for r, t in zip(rows, texts, strict=True) if len(t) > 400]
    assert sum(r.near_edited > r.near_next for r in far) / len(far) > 0.9


def test_odd_rows(spark, odd, none):
    rows = simhash.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    docs = sorted({(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect()})
    for (i, t), e in zip(docs, edit([t for _, t in docs]), strict=True):
        by[i] = (len(t), hashlib.sha256(e.encode()).hexdigest())
    for r in rows:
        assert (r.n_chars, r.edited_sha256) == by[r.doc_id if r.doc_id is not None else -1]
    assert simhash.fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "only one document")], "doc_id long, text string")
    r = simhash.fingerprints(one).first()
    assert r.fp == r.next_fp


def test_block_tables_find_every_pair(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for k in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << k
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), 1) for x in fps], "fp long, n long")
    got = [(x.fp, x.other) for x in simhash.near(df.where(F.col("fp") % 3 == 0), df).collect()]
    want = {(signed(a), signed(b)) for a in fps if signed(a) % 3 == 0 for b in fps if a != b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def voted(text):
    """The fingerprint by plain sums over the words."""
    votes = [0] * 64
    for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        h, n = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), simhash.LONG) ** 2
        for j in range(64):
            votes[j] += n if h >> j & 1 else -n
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_votes_against_plain_sums(spark, sf, monkeypatch):
    """Whole and edited texts; then in parts of four words, as texts beyond the lanes' room are added up."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '^[\\\\x00-\\\\x7f]*$'").orderBy("doc_id").limit(150).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**9, ""), (10**9 + 1, " x  yy\n"), (10**9 + 2, "w" * 40 + " " + "v" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    edited = edit([t for _, t in rows])
    for part in (simhash.PART, 4):
        monkeypatch.setattr(simhash, "PART", part)
        got = {r.doc_id: r for r in simhash.fingerprints(df).collect()}
        for (i, t), e in zip(rows, edited, strict=True):
            assert got[i].fp % 2**64 == voted(t) and got[i].edited_fp % 2**64 == voted(e)
