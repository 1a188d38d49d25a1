"""What a task holds stays the same as inputs grow: where rows are counted, how they are dealt, what is shuffled."""

import random
from collections import Counter

from pyspark.sql import functions as F

from corvidex import queries
from corvidex.functions import clean, tokens
from corvidex.operators import fts, tfidf
from corvidex.plans import shared
from corvidex.sources import fixtures, store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_the_row_of_a_document(spark):
    texts = [(1, ["b", "a", "b", None, "b", None]), (2, []), (3, None), (4, ["x"])]
    docs = spark.createDataFrame(texts, "id long, t array<string>")
    got = tfidf.term_rows(docs, "id", F.col("t"))
    assert "Exchange" not in plan(got)
    want = sorted(((i, t, n, len(ts)) for i, ts in texts if ts for t, n in Counter(ts).items()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and got.columns == ["doc", "term", "tf", "len"]


def test_stored_tables_are_dealt_by_the_size_of_their_source(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in.parquet")
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) as t").write.parquet(source)
    monkeypatch.setattr(shared, "SHARE_BYTES", 100_000)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []

    def build():
        seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.files.maxPartitionBytes"))))
        return spark.read.parquet(source)

    assert store.stored(spark, source, "dealt", build, ["t"]).count() == 20_000
    size = store.size_of(spark, source)
    assert seen == [(-(-size // 100_000), 100_000)] and size > 1_000_000
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.sql.files.maxPartitionBytes") != "100000"


def test_only_rows_of_seldom_terms_are_shuffled(spark, monkeypatch):
    r = random.Random(1)
    rows = [(d, " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(60))) for d in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string")
    one = tfidf.Corpus.of(docs, "id", F.split("text", " "))
    terms = shared.written(one.df())
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 200)
    both = tfidf.Corpus(one.tf, one.n, terms, size=1 << 40)
    monkeypatch.setattr(shared, "SHARE_BYTES", 1 << 33)
    least = both.frequent()
    assert least > 1 and 0 < terms.where(F.col("df") >= least).count() <= 50
    for f in (lambda c: c.keywords(), lambda c: c.keywords(top=3), lambda c: c.pure(), lambda c: c.light()):
        assert sorted(map(repr, f(one).collect())) == sorted(map(repr, f(both).collect()))
    assert "BroadcastHashJoin" in plan(both.light())
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 1_000_000)
    assert both.frequent() == 1 and "SortMergeJoin" not in plan(both.light())


def test_patterns_said_as_ranges_match_the_same_characters(spark):
    points = spark.createDataFrame([(chr(i),) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 37 == 0 or i > 0x10FF00)], "c string")
    assert points.where(F.col("c").rlike(clean.MARKS) != F.col("c").rlike(r"[^\w\s\-_.]")).count() == 0
    assert points.where(F.col("c").rlike(tokens.NO_WORD) != F.col("c").rlike("[^a-z0-9_]+")).count() == 0


def test_cells_are_counted_where_they_are(spark):
    """As the grouped postings, ids of several rows too; only those are shuffled."""
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, None, ""), (3, "a", "y z"), (3, "a c", "z")], "id long, a string, b string")
    p = fts.postings(docs, "id", ["a", "b"])
    want = p.groupBy("doc", "col").agg(F.count(F.lit(1)), F.count_distinct("term"), F.sum("pos"))
    cell = fts.cells(docs, "id", ["a", "b"])
    got = fts.cell_counts(cell, tfidf.repeated(docs, "id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, fts.cell_lengths(cell).collect())) == sorted(map(tuple, fts.lengths(p).collect()))
    columns = p.groupBy("col").agg(F.count(F.lit(1)), F.count_distinct("term"), F.count_distinct("doc"))
    assert sorted(map(tuple, fts.column_counts([cell]).collect())) == sorted(map(tuple, columns.collect()))
    found = queries.fts_postings(spark, SF)
    found.collect()
    final = plan(found).split("Initial Plan")[0]
    assert "Exchange hashpartitioning" not in final


def test_texts_of_items_pass_no_join(spark, tmp_path, monkeypatch):
    """Postings of the wide view are those of its rows, whether its texts go apart or, where an event is listed twice, with the rest."""
    (texts, columns), (rest, others) = queries.issue_parts(spark, SF)
    assert columns == ["title", "description"] and not set(columns) & set(others)
    assert "Join" not in plan(texts) and "text#" not in plan(fts.cells(rest, "issue_key", others))
    rows = lambda df: sorted(map(tuple, df.select("term", "doc", "col", "pos").collect()))
    assert rows(queries.issue_post(spark, SF)) == rows(fts.issue_postings(queries.wide_view(spark, SF)))
    for name in ("documents", "labels", "pages"):
        fixtures.table(spark, SF, name).limit(20).write.parquet(str(tmp_path / f"{name}.parquet"))
    events = fixtures.table(spark, SF, "events").where("event_id < 20")
    events.unionByName(events.where("event_id = 3")).write.parquet(str(tmp_path / "events.parquet"))
    assert len(queries.issue_parts(spark, str(tmp_path))) == 1
    assert rows(queries.issue_post(spark, str(tmp_path))) == rows(fts.issue_postings(queries.wide_view(spark, str(tmp_path))))


def test_titles_are_joined_without_their_texts(spark):
    titles = plan(fixtures.issues(spark, SF).select("issue_key", "title", "status")).replace(" ", "")
    assert "substring(text" in titles[titles.rindex("Join") :]


def test_stems_split_the_texts_once(spark):
    """The terms of all texts are those of each text's tokens; what is returned reads no text again."""
    docs = fixtures.table(spark, SF, "documents").limit(60).union(spark.createDataFrame([(-1, "Patient $expand <b>R4</b> &amp; MEDICATION Kelvin İx 2019 the", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    want = {r.term for r in docs.select(F.explode(tokens.preprocessed(F.col("text"))).alias("term")).distinct().collect()}
    got = [r.term for r in tokens.preprocessed_terms(docs, F.col("text")).collect()]
    assert set(got) == want and len(got) == len(want) and "PATIENT" in want
    assert not [f for f in queries.porter_stems(spark, SF).inputFiles() if "documents.parquet" in f]
