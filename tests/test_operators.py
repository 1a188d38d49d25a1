import http.server
import math
import random
import tarfile
import threading
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvidex import queries
from corvidex.operators import fts, graph, keywords, quality, tfidf, tools, upsert
from corvidex.operators.tfidf import Corpus, Options, cosine_to, scores, validation
from corvidex.plans import recovery, shared
from corvidex.sources import feed, store, weekly
from corvidex.streaming import ingest

CORPUS = [
    ("doc1", "Spec Patient resource contains demographic information"),
    ("doc2", "Patient data includes name address and contact information"),
    ("doc3", "Spec Observation resource stores clinical measurements"),
    ("doc4", "Clinical data analysis using TF-IDF for keyword extraction"),
    ("doc5", "Healthcare interoperability requires standardized data formats"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: F.length(t) > 2)
    return Corpus.of(spark.createDataFrame(CORPUS, "id string, text string"), "id", tokens)


def test_light_scores(corpus):
    got = {(r.doc, r.term): round(r.score, 6) for r in corpus.light().collect()}
    assert len({t for _, t in got}) == 27
    assert got["doc1", "contains"] == 0.26824 and got["doc1", "spec"] == 0.152715
    assert got["doc2", "data"] == 0.063853 and got["doc4", "clinical"] == 0.114536 and got["doc5", "data"] == 0.085138


def test_scorers_and_similarity(corpus):
    wide = Options(min_df=1, max_df=1.0)
    top = corpus.keywords(wide, top=3).collect()
    assert max(Counter(r.issue_key for r in top).values()) == 3
    v = corpus.keywords(wide).select(F.col("issue_key").alias("doc"), F.col("keyword").alias("term"), F.col("tfidf_score").alias("w"))
    ab = {r.doc: r.similarity for r in cosine_to(v, "doc1").collect()}
    ba = {r.doc: r.similarity for r in cosine_to(v, "doc2").collect()}
    assert abs(ab["doc2"] - ba["doc1"]) < 1e-12 and all(0 <= x <= 1 + 1e-12 for x in ab.values()) and len(ab) == 4 and ab["doc5"] == 0
    assert all(r.tfidf > 0 for r in corpus.pure(wide).collect())
    h = corpus.health().first()
    assert h.score == 100 and list(h.findings) == []
    assert Options(max_df=2).problems() and not Options().problems()


XML = """<rss><channel>{items}</channel></rss>"""
ITEM = """<item><title>{t}</title><link>l</link><key id="1{n}">K-{n}</key><project id="5" key="P">Proj</project><status id="3">Open<statusCategory id="9" key="new" colorName="blue"/></status>
<created>Mon, 21 Jul 2025 10:00:00 +0000</created><updated>bad date</updated><watches>{w}</watches><customfields>
<customfield id="a" key="k"><customfieldname>Work Group</customfieldname><customfieldvalues><customfieldvalue>A &amp;amp; B</customfieldvalue></customfieldvalues></customfield>
<customfield id="b" key="k"><customfieldname>Related Page(s)</customfieldname><customfieldvalues><customfieldvalue key="1">p1</customfieldvalue><customfieldvalue key="2">p2</customfieldvalue></customfieldvalues></customfield>
</customfields><comments><comment id="c{n}" author="x" created="Mon, 21 Jul 2025 10:00:00 +0000">hello</comment><comment author="y">anonymous</comment></comments></item>"""


def drop(folder, name, *items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(XML.format(items="".join(ITEM.format(t=t, n=n, w=w) for t, n, w in items) + "<item><title>no key</title></item>"))


def test_feed_shredding_and_wide_view(spark, tmp_path):
    drop(tmp_path / "in", "a.xml", ("one", 1, "7"), ("two", 2, "many"))
    items = feed.read_feed(spark, str(tmp_path / "in"))
    issues = {r.key: r for r in feed.issues_of(items).collect()}
    assert set(issues) == {"K-1", "K-2"} and issues["K-1"].watches == 7 and issues["K-2"].watches == 0
    assert issues["K-1"].id == 11 and issues["K-1"].status == "Open" and issues["K-1"].status_category_color == "blue" and issues["K-1"].updated_at is None and issues["K-1"].created_at is not None
    attrs = feed.attributes_of(items)
    assert {(r.field_name, r.field_value) for r in attrs.collect()} == {("Work Group", "A &amp; B"), ("Related Page(s)", "p1, p2")}
    assert feed.comments_of(items).count() == 4
    w = upsert.wide(feed.issues_of(items).withColumnRenamed("key", "issue_key"), attrs, [F.col("elem_pos")]).where("issue_key = 'K-1'").first()
    assert (w.work_group, w.related_pages, w.issue_int, w.related_url) == ("A & B", "p1, p2", 1, "")
    two = attrs.unionByName(attrs)
    assert upsert.pivoted(two, [F.col("elem_pos")]).count() == 2
    assert upsert.pivoted_by_joins(feed.issues_of(items).select(F.col("key").alias("issue_key")), two).count() == 8


def test_streaming_upserts_equal_batches(spark, tmp_path):
    folder, root, ck = tmp_path / "drop", str(tmp_path / "store"), str(tmp_path / "ck")
    drop(folder, "a.xml", ("one", 1, "1"), ("two", 2, "2"))
    ingest.ingest(spark, str(folder), root, ck).awaitTermination()
    drop(folder, "b.xml", ("one again", 1, "5"), ("three", 3, "3"))
    ingest.ingest(spark, str(folder), root, ck).awaitTermination()
    v = ingest.Versions(spark, root)
    assert {(r.key, r.title, r.watches) for r in v.read("issues").collect()} == {("K-1", "one again", 5), ("K-2", "two", 2), ("K-3", "three", 3)}
    assert v.read("custom_fields").count() == 6
    assert Counter(r.comment_id for r in v.read("comments").collect()) == {"c1": 1, "c2": 1, "c3": 1, None: 4}


def test_archives(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<a/>")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "x.xml", "top/x.xml")
    assert [(r.name, bytes(r.content)) for r in feed.extracted(spark, str(tmp_path / "a.tar.gz")).collect()] == [("x.xml", b"<a/>")]


def test_ranges_and_requests(spark):
    w = feed.week_ranges(spark, "2025-07-22", limit=2).select("*", feed.range_text(F.col("week_start"), F.col("week_end"), "R").alias("q")).collect()
    assert (str(w[0].week_start), str(w[0].week_end), str(w[1].week_start)) == ("2025-07-20", "2025-07-22", "2025-07-13")
    assert w[0].q == "Specification = 'R' and updated <= '2025-07-22 23:59' and updated >= '2025-07-20 00:00'"


def test_store(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    store.save_table(df, str(tmp_path), "t", sort=["v"])
    assert store.read_store(spark, str(tmp_path), "t").count() == 5 and store.resolve_store(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        store.resolve_store(spark, str(tmp_path / "none"))
    path = store.snapshot(df, str(tmp_path), "t", "1")
    assert store.differences(df, spark.read.parquet(path)).count() == 0 and store.differences(df, df.limit(4)).count() == 1
    assert store.missing_columns(df, ["id", "x"]) == ["x"]
    work = spark.createDataFrame([("# list\n### A-1\ntext\n### A-3\n",)], "text string")
    assert [r.issue_key for r in store.pending(spark.createDataFrame([("A-1",), ("A-2",)], "issue_key string"), work).collect()] == ["A-2"]


def test_query_parser():
    n = fts.parse('a b OR c NOT "d e" AND f*')
    assert n.op == "or" and n.parts[0].op == "and" and n.parts[1].op == "and" and n.parts[1].parts[0].op == "not" and n.parts[1].parts[1] == fts.Node("prefix", ("f",))
    for bad in ("", "a-b", "(a", "AND a", "a OR", '""', "a)"):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)


def test_bm25_and_phrases(spark):
    rows = [(1, "the café is open", ""), (2, "cafe cafe closed", "open"), (3, "nothing here at all", ""), (4, "is open the cafe", None)]
    post = fts.postings(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"])
    assert {r.doc for r in fts.search(post, "Café open").collect()} == {1, 2, 4}
    assert {r.doc for r in fts.search(post, '"is open"').collect()} == {1, 4} and {r.doc for r in fts.search(post, '"cafe is open"').collect()} == {1}
    assert {r.doc for r in fts.search(post, "open", ["b"]).collect()} == {2} and {r.doc for r in fts.search(post, "clo* OR (nothing NOT at)").collect()} == {2}
    lengths = {1: 4, 2: 4, 3: 4, 4: 4}
    avg = sum(lengths.values()) / 4
    idf = math.log((4 - 1 + 0.5) / 1.5)
    r = fts.search(post, "closed").first()
    assert abs(r["rank"] + idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / avg))) < 1e-9
    ranks = [r["rank"] for r in fts.search_any_column(post, "cafe", ["a"], 10, order="reference").collect()]
    assert ranks == sorted(ranks, reverse=True)


def wide_rows(spark):
    cols = "issue_key string, issue_int long, project_key string, work_group string, title string, description string, summary string, resolution_description string, related_url string, related_artifacts string, related_pages string"
    rows = [
        ("F-1", 1, "P", "W", "alpha", "d", "s", "", "https://example.com/spec.html,", "art1, art2", ""),
        ("F-2", 2, "P", "W", "beta", "d", "s", "", "http://other.org/x/SPEC.htm", "has art2 inside", ""),
        ("F-3", 3, "P", "W", "gamma alpha", "d", "s", "", "http://other.org/else", "art1", ""),
        ("F-4", 4, "Q", "W", "alpha alpha", "d", "s", "", "", "", ""),
    ]
    return spark.createDataFrame(rows, cols)


def test_tools(spark):
    df = wide_rows(spark)
    post = fts.postings(df, "issue_key", tools.SEARCH_FIELDS)
    attrs = spark.createDataFrame([("F-1", "Related Issues", "F-9, F-3,"), ("F-1", "Priority", "Low"), ("F-1", "Priority", "High")], "issue_key string, field_name string, field_value string")
    linked = tools.linked_keys(attrs, "F-1")
    assert [r.issue_key for r in tools.related_keys(df, post, "F-1", linked, "alpha").collect()][:3] == ["F-9", "F-3", "F-2"]
    assert "F-4" in [r.issue_key for r in tools.find_related(df, post, "F-1", linked, "alpha").collect()]
    assert [r.issue_key for r in tools.list_items(df, project_key="P", work_group=None, limit=2).collect()] == ["F-3", "F-2"]
    assert [r.issue_key for r in tools.search_items(df, post, "alpha").collect()][0] == "F-4"
    d = tools.details(df, attrs, spark.createDataFrame([("F-1", "x")], "issue_key string, body string"), [F.col("field_value")], "F-1").first()
    assert d.comment_count == 1 and d.custom_fields["Priority"] == "Low"
    kw = spark.createDataFrame([("F-1", "terminology", 0.85), ("F-1", "validation", 0.72), ("F-1", "specification", 0.68), ("F-1", "x", 0.1)], "issue_key string, keyword string, tfidf_score double")
    assert tools.keyword_query(kw, "F-1").first()["query"] == "terminology OR validation OR specification"
    assert keywords.chart(kw).first().metadata.totalKeywords == 4
    with pytest.raises(LookupError):
        tools.related_keys(df, post, "none", linked)


def test_components_match_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, None), (5, "z")], "i long, v string")
    assert {(x.i, x.group) for x in graph.groups_by_value(rows, "i", "v").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_registered_component_search_sees_every_row(spark, tmp_path):
    """A hot value, a chain, singletons and nulls; then a whole table."""
    pairs = [(i, 1) for i in range(1, 300)] + [(1000 + i, 5000 + i + k) for i in range(40) for k in (0, 1)] + [(3000, 1), (3000, 7), (3001, 7), (4000, 9), (4001, None), (None, 9)]
    spark.createDataFrame(pairs, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        items = set()
        for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
            if r[0] is not None:
                items.add(r[0])
                if r[1] is not None:
                    a, b = root((0, r[0])), root((1, r[1]))
                    up[max(a, b)] = min(a, b)
        got = queries.QUERIES["related_groups"](spark, d).collect()
        assert sorted((x.item, x.group) for x in got) == sorted((i, root((0, i))[1]) for i in items)


def test_packing_of_groups():
    out = graph.packed_batches([("a", 7), ("b", 3), ("c", 2), ("d", 23)], 10)
    assert out == [[("d", 0, 10)], [("d", 10, 20)], [("d", 20, 23)], [("a", 0, 7), ("b", 0, 3)], [("c", 0, 2)]]


def test_dealt_batches_are_the_packed_ones(spark):
    r = random.Random(3)
    sizes = [(f"g{i}", r.choice((1, 2, 3, 3, 5, 7, 10, 11, 25))) for i in range(500)]
    got = graph.dealt_batches(spark.createDataFrame(sizes, "name string, n int"), "name", "n", 10).collect()
    of = lambda batches: Counter(tuple(sorted(b, reverse=True)) for b in batches)
    mine = {}
    for x in got:
        mine.setdefault(x.batch, []).append(x.to - x["from"])
    assert of(mine.values()) == of([[to - at for _, at, to in b] for b in graph.packed_batches(sizes, 10)])
    assert Counter(x.group for x in got if x.size <= 10) == Counter(n for n, k in sizes if k <= 10)
    assert graph.dealt_batches(spark.createDataFrame([], "name string, n int"), "name", "n", 10).count() == 0


def test_rollups(spark):
    ev = spark.createDataFrame([("op1", 500), ("op2", 1200), ("op3", 300), ("op1", 800), ("op4", 6000)], "op string, ms long")
    rows = [(r.op, r.events, r.total, r["mean"], r.longest, r.slow_share) for r in quality.lock_report(ev, "op", "ms", slow=600).collect()]
    assert rows == [("op4", 1, 6000, 6000.0, 6000, 1.0), ("op1", 2, 1300, 650.0, 800, 0.5), ("op2", 1, 1200, 1200.0, 1200, 1.0), ("op3", 1, 300, 300.0, 300, 0.0)]
    b = quality.batch_outcome(spark.createDataFrame([("failed",)] * 60 + [("ok",)] * 50 + [("skipped",)] * 2, "status string")).first()
    assert (b.processed, b.failed, b.skipped, b.stop_early, b.can_continue) == (112, 60, 2, True, True)
    s = spark.createDataFrame([("fatal timeout", 0), ("timeout", 0), ("db: database", 0), ("x", 2), ("x", 0)], "m string, n int").select(quality.error_severity(F.col("m"), F.col("n")).alias("s"))
    assert [r.s for r in s.collect()] == ["critical", "high", "medium", "medium", "low"]
    q = quality.list_quality(spark.createDataFrame([(",a,,b",), ("",), ("a, b",)], "related_pages string"), "related_pages").first()
    assert (q.malformed, q.empty) == (1, 1)
    assert quality.suite(spark.createDataFrame([("a", "PASS"), ("b", "FAIL")], "name string, status string")).first().health == 50.0


def test_retries():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("connection reset")
        return "ok"

    assert recovery.with_retry(flaky, sleep=pauses.append) == "ok" and pauses == [1.0, 2.0]
    assert recovery.delays(6) == [1, 2, 4, 8, 10]
    with pytest.raises(ValueError):
        recovery.with_retry(lambda: (_ for _ in ()).throw(ValueError("wrong")), sleep=pauses.append)
    assert recovery.with_fallback(lambda: 1 / 0, lambda e: type(e).__name__) == "ZeroDivisionError"
    assert quality.health(3, 100, 11, 5, 10.0) == ["too many timeouts"] and not quality.health(0, 0, 0, 0, 0.0)


def test_small_and_empty_corpora(spark, corpus):
    few = Corpus.of(spark.createDataFrame([("a", "x y"), ("b", "x z")], "id string, text string"), "id", F.split("text", " "))
    assert {r.term for r in few.pure().collect()} == {"y", "z"} and few.pure_stats().count() == 0
    one = Corpus.of(spark.createDataFrame([("a", "x y x")], "id string, text string"), "id", F.split("text", " "))
    assert {(r.term, r.idf) for r in one.pure().collect()} == {("x", 1.0), ("y", 1.0)}
    none = corpus.keywords(Options(min_df=99))
    s = keywords.stats(none).first()
    assert (s.total_keywords, s.avg_keywords_per_issue) == (0, None)


def test_methods_and_validation(spark, corpus):
    wide = Options(min_df=1, max_df=1.0)
    assert scores(corpus, "light").count() == scores(corpus, "library", wide).count()
    with pytest.raises(ValueError):
        scores(corpus, "other")
    docs = spark.createDataFrame([*CORPUS, ("doc6", "a")], "id string, text string")
    v = validation(corpus, docs, "id", wide).first()
    assert (v.given, v.counted, v.terms, list(v.amiss)) == (6, 5, 27, ["documents without terms"])


def test_a_repeated_id_counts_once(spark):
    """The first by order counts, whatever else has the id; null ids and documents without tokens don't."""
    rows = [("a", "one two", 1), ("a", "three three", 0), ("b", "two", 0), ("b", "two", 0), (None, "two two", 0), ("c", "", 0)]
    docs = tfidf.first_of_each(spark.createDataFrame(rows, "id string, text string, o int"), "id", F.col("o"))
    c = Corpus.of(docs, "id", F.filter(F.split("text", " "), lambda t: t != ""))
    assert c.n == 2 and {(r.doc, r.term, r.tf) for r in c.tf.collect()} == {("a", "three", 2), ("b", "two", 1)}
    c = Corpus.of(spark.createDataFrame(rows[:4], "id string, text string, o int"), "id", F.split("text", " "))
    assert c.n == 2 and c.tf.groupBy("doc").agg(F.sum("tf").alias("n")).count() == 2


def test_options_and_methods(spark, corpus):
    wrong = Options(min_df=0, max_df=1.5, min_length=60, max_length=10, top=0, batch=0)
    assert len(wrong.problems()) == 6 and Options(min_df=900, max_df=0.05).problems() == ["max_df is too low beside min_df"]
    assert {r.method for r in tfidf.capabilities(spark).collect()} == {"library", "pure", "light"}
    none = Options(min_df=100)
    assert scores(corpus, "library", none).count() == 0 and scores(corpus, "library", none, fallback=("pure", "light")).count() == corpus.light().count()
    v = corpus.light().withColumnRenamed("score", "w")
    assert abs(tfidf.cosine(v, "doc1", "doc1").first().similarity - 1) < 1e-12 and tfidf.cosine(v, "doc1", "none").first().similarity == 0
    assert [r.doc for r in tfidf.similar(v, "doc1", 2).collect()][0] in ("doc2", "doc3")


def test_near_ties_go_by_id(spark):
    """Likenesses that differ in their last bits only are ties, as in the SQL; a document that shares no term is not near."""
    turned = [(4, "a", 0.3), (4, "b", 0.4), (4, "c", 0.1), (2, "a", 0.3), (2, "b", 0.4), (2, "c", 0.1 + 1e-15), (9, "z", 1.0)]
    v = spark.createDataFrame([(1, "a", 0.3), (1, "b", 0.4), (1, "c", 0.1 - 3e-15), *turned], "doc int, term string, w double")
    assert [r.doc for r in tfidf.similar(v, 1, 5).collect()] == [2, 4]
    kw = spark.createDataFrame([("i", "b", 1.0), ("i", "a", 1.0 - 2e-15), ("j", "c", 0.5)], "issue_key string, keyword string, tfidf_score double")
    own = spark.createDataFrame([("i", "p"), ("j", "p")], "issue_key string, project_key string")
    assert [r.keyword for r in keywords.project_keywords(kw, own, "p").collect()] == ["a", "b", "c"]
    assert [r.keyword for r in keywords.top_by_score(kw, min_issues=1).collect()] == ["a", "b", "c"]


def test_items_without_a_key_leave_nothing_behind(spark, tmp_path):
    drop(tmp_path / "in", "a.xml", ("one", 1, "7"))
    (tmp_path / "in" / "b.xml").write_text(XML.format(items=ITEM.format(t="x", n=9, w=1).replace("K-9", "")))
    items = feed.read_feed(spark, str(tmp_path / "in"))
    assert {r.issue_key for f in (feed.attributes_of, feed.comments_of) for r in f(items).collect()} == {"K-1"} == {r.key for r in feed.issues_of(items).collect()}


def test_log_is_a_ring(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        store.append_log(spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("ts"), F.lit("x" * 3).alias("m")), path, keep=15)
    assert sorted(r.ts for r in store.read_log(spark, path, "ts long, m string").collect()) == list(range(15, 30))
    (tmp_path / "log" / "more.json").write_text('{"ts": 99, "m": "y"}\nnot json\n')
    assert max(r.ts for r in store.read_log(spark, path, "ts long, m string").collect()) == 99
    assert store.read_log(spark, path, "ts long, m string").count() == 16
    store.append_table(spark.range(2), str(tmp_path), "t")
    store.append_table(spark.range(2), str(tmp_path), "t")
    assert store.read_store(spark, str(tmp_path), "t").count() == 4
    assert store.name_differences(["a", "b"], ["b", "c"]) == {"missing": ["a"], "extra": ["c"]}
    spark.range(1).createOrReplaceTempView("some_view")
    assert store.columns(spark, "some_view") == [("id", "bigint")]


def test_weekly_downloads(spark, tmp_path):
    """Two weeks from a local server, one of them after a failed try, one that fails."""
    tries = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] += 1
            good = self.path == "/a" or self.path == "/b" and tries[self.path] > 1
            self.send_response(200 if good else 503)
            self.end_headers()
            self.wfile.write(b"<rss><item></item><item></item></rss>" if good else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    weeks = feed.week_ranges(spark, "2025-07-22", limit=3)
    asked = weeks.withColumn("url", F.concat(F.lit(base + "/"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.row_number().over(Window.orderBy("week_start"))).cast("int"))))
    got = weekly.download(spark, asked, tries=2, pause=0.01, timeout=5).drop("content").cache()
    rows = sorted(got.collect())
    server.shutdown()
    assert [(str(r.week_start), r.ok, r.rows) for r in rows] == [("2025-07-06", True, 2), ("2025-07-13", True, 2), ("2025-07-20", False, 0)] and "503" in rows[2].error
    assert store.manifest(got).first().asDict() == {"weeks": 3, "succeeded": 2, "failed": 1, "total_rows": 4}
    said = [r.text for r in store.manifest_lines(got).orderBy("line").collect()]
    assert said[:4] == ["weeks: 3", "succeeded: 2", "failed: 1", "2025-07-06 ok 2 rows"] and said[5].startswith("2025-07-20 failed")
    pauses = []
    with pytest.raises(OSError):
        weekly.fetched("x", 3, 2.0, fetch=lambda url, t: (_ for _ in ()).throw(OSError("away")), sleep=pauses.append)
    assert pauses == [2.0, 4.0]


def test_time_limits_and_statements(spark):
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(TimeoutError):
        recovery.with_time_limit(spark, spark.range(4).select(slow("id")).collect, 2.0)
    assert recovery.get(spark, "select :a + 1 as b", {"a": 2}).b == 3 and recovery.get(spark, "select 1 where false") is None
    assert len(recovery.rows(spark, "select * from range(10)", most=4)) == 4


def test_logged_rows_and_batches(spark):
    row = quality.loggable_row(spark.createDataFrame([("x" * 300, [1], 5)], "a string, b array<int>, c int")).first()
    assert (len(row.a), row.b, row.c) == (203, "[Object]", 5)
    docs = spark.createDataFrame([("k", "t"), ("", "t"), (None, None), ("l", " ")], "key string, title string")
    kept, counts = quality.valid_batch(docs, "key", "title")
    assert {r.key for r in kept.collect()} == {"k", "l"} and counts.first().asDict() == {"given": 4, "keyless": 2, "untitled": 1}
    items = spark.createDataFrame([("a", "5"), ("b", "five"), ("c", "x"), (None, "1")], "key string, v string")
    out = quality.recovered(items, "key", F.col("v").try_cast("int"), F.when(F.col("v") == "five", 5))
    assert [(r.key, r.value, r.status) for r in out.collect()] == [("a", 5, "ok"), ("b", 5, "recovered"), ("c", None, "failed"), (None, None, "skipped")]


def test_streamed_term_counts(spark, tmp_path):
    src = tmp_path / "docs"
    spark.createDataFrame([(1, "a b a")], "id long, text string").write.parquet(str(src / "one"))
    count = lambda df: tfidf.term_counts(df, "id", F.split("text", " "))
    for extra in (None, "two"):
        if extra:
            spark.createDataFrame([(2, "b c")], "id long, text string").write.parquet(str(src / extra))
        stream = spark.readStream.schema("id long, text string").option("recursiveFileLookup", "true").parquet(str(src))
        ingest.stream_term_counts(stream, count, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "tf"))
    assert {(r.doc, r.term, r.tf) for r in got.collect()} == {(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)}


def test_broadcasts_are_bounded_by_bytes(spark):
    few = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert shared.small(few) and not shared.small(few, most=5000) and not shared.small(few, limit=5)
    nested = few.select(F.struct("s").alias("k"))
    assert not shared.small(nested, most=5000)
