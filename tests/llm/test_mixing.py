import re
from collections import defaultdict

from corvidex.llm import mixing
from corvidex.llm.queries import op10_source_mix

W = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    """Targets by plain rounds."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(2 * sizes[s] for s in fixed)
        goal = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] >= 2 * sizes[s]}
        if not over:
            return goal | {s: 2 * sizes[s] for s in fixed}
        fixed |= over


def check(docs, rows, source="source"):
    sizes, rows = defaultdict(int), rows.collect()
    for r in docs.collect():
        sizes[r[source]] += len(W.findall(r.text or ""))
    want, taken = fill(sizes), defaultdict(int)
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - want[r.src]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.src]
        assert r.taken >= r.epochs * r["size"]
        taken[r.src] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    return sorted((str(r.doc_id), r.taken) for r in rows)


def test_mix_meets_targets_and_reruns_agree(spark, sf, odd, none):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        assert check(docs, mixing.mix(docs)) == check(docs, mixing.mix(docs.repartition(5)))
    assert op10_source_mix(spark, sf).count() == 1000
    assert mixing.mix(none).count() == 0


def test_documents_follow_the_mix(spark, odd, none):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    by = defaultdict(int)
    for r in out.collect():
        by[r.doc_id] += len(W.findall(r.text or ""))
    want = defaultdict(int)
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.taken
    assert by == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(none).count() == 0


def test_good_documents_come_first(spark):
    """Half of the source is taken once more; by weights 1.5 and 0.83 three fifths of that half are prose, by chance alone half."""
    docs = spark.createDataFrame([(i, ("plain words here " if i % 2 else "12 ## 99 ") * 5, "s") for i in range(4000)] + [(9000 + i, "many words " * 50, f"t{i}") for i in range(3)], "doc_id long, text string, source string")
    more = [r for r in mixing.mix(docs).where("src = 's'").collect() if r.taken > r.epochs * r["size"]]
    assert 1800 <= len(more) <= 2200
    assert 0.56 <= sum(r.doc_id % 2 for r in more) / len(more) <= 0.64


def test_prose_of_every_script_weighs_alike(spark):
    texts = ["plain words", "слова просто так", "普通的文字", "λόγια απλά"]
    assert {round(r.w, 9) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.quality_weight(mixing.F.col("t")).alias("w")).collect()} == {1.5}
