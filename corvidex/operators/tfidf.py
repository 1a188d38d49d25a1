"""Term weights over a corpus of (doc, tokens): three scorers, similarity, corpus figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvidex.functions.tokens import counted
from corvidex.operators.upsert import first_rows
from corvidex.plans.shared import BROADCAST_BYTES, BROADCAST_ROWS, checked, shares, written


@dataclass(frozen=True)
class Options:
    """Document frequency band (the upper end as a share), token lengths, keywords kept of a document, documents of a batch."""

    min_df: int = 2
    max_df: float = 0.7
    min_length: int = 2
    max_length: int = 30
    top: int = 10
    batch: int = 5000

    def problems(self) -> list[str]:
        """What is out of range, in words."""
        # The ranges.
        rules = (
            (not 1 <= self.batch <= 10_000, "batch must lie in 1 to 10000"),
            (not 1 <= self.top <= 100, "top must lie in 1 to 100"),
            (not 1 <= self.min_df <= 1000, "min_df must lie in 1 to 1000"),
            (not 0 < self.max_df <= 1, "max_df must lie in (0, 1]"),
            (not 1 <= self.min_length <= 50, "min_length must lie in 1 to 50"),
            (not self.min_length <= self.max_length <= 100, "max_length must lie in min_length to 100"),
            (self.max_df < self.min_df / 10_000, "max_df is too low beside min_df"),
        )
        return [said for wrong, said in rules if wrong]


def repeated(docs: DataFrame, doc: str) -> DataFrame:
    """again: the ids of more than one row, written."""
    return written(docs.groupBy(F.col(doc).alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("again"), "again")


def first_of_each(docs: DataFrame, doc: str, order: Column) -> DataFrame:
    """``docs`` without rows of a null id, and of rows that repeat an id the first by ``order``.

    One narrow aggregate over the ids; only rows of repeated ids are ranked.
    """
    rows = docs.where(F.col(doc).isNotNull())
    again = repeated(rows, doc)
    if again.isEmpty():
        return rows
    side = checked(again)
    single = rows.join(side, F.col(doc) == F.col("again"), "left_anti")
    return single.unionByName(first_rows(rows.join(side, F.col(doc) == F.col("again"), "left_semi"), [doc], [order]))


def term_rows(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """doc, term, tf, len (tokens of the document); the first of the documents of an id counts. Counted within the row of a document, without a shuffle."""
    rows = first_of_each(docs, doc, F.xxhash64(F.to_json(F.struct(tokens))))
    return rows.select(F.col(doc).alias("doc"), F.inline(counted(tokens)))


def term_counts(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """doc, term, tf of :func:`term_rows`."""
    return term_rows(docs, doc, tokens).drop("len")


@dataclass
class Corpus:
    """Term counts (doc, term, tf, len) on disk, in the order of the documents, read by every statistic; n: documents with a token.

    terms: (term, df) on disk, where there is such a table; size: bytes of the documents, where known.
    """

    tf: DataFrame
    n: int
    terms: DataFrame | None = None
    size: int = 0

    @classmethod
    def of(cls, docs: DataFrame, doc: str, tokens: Column) -> Corpus:
        """Of repeated ids one document counts, documents without tokens none."""
        tf = written(term_rows(docs, doc, tokens), "tf")
        return cls(tf, tf.agg(F.count_distinct("doc").alias("n")).first()["n"])

    def df(self) -> DataFrame:
        return self.terms if self.terms is not None else self.tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def weighed(self, band: Column | None = None) -> DataFrame:
        """doc, term, tf, len, df of terms in the band.

        The most frequent terms, which make most of the rows, are broadcast; only the rows of
        the others are shuffled. Without a table of terms there is one shuffle join.
        """
        inside = lambda t: t if band is None else t.where(band)
        if self.terms is None:
            return self.tf.join(inside(self.df()), "term")
        least = self.frequent()
        often = self.terms.where(F.col("df") >= least)
        found = self.tf.join(F.broadcast(inside(often)), "term")
        if least <= 1:
            return found
        seldom = self.tf.join(F.broadcast(often.select("term")), "term", "left_anti")
        others = inside(self.terms.where(F.col("df") < least))
        spark = self.tf.sparkSession
        if (n := shares(spark, self.size // 8)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
            seldom, others = seldom.repartition(n, "term"), others.repartition(n, "term")
        return found.unionByName(seldom.join(others, "term"))

    def frequent(self) -> int:
        """The least df, a power of two, such that the terms from there on may be broadcast: a quarter of the bounds of a broadcast."""
        level = F.floor(F.log2("df")).cast("int")
        levels = self.terms.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(16 + F.coalesce(F.octet_length("term"), F.lit(0))).alias("bytes")).collect()
        rows = size = 0
        for r in sorted(levels, key=lambda r: -r["level"]):
            rows, size = rows + r["n"], size + r["bytes"]
            if rows > BROADCAST_ROWS // 4 or size > BROADCAST_BYTES // 4:
                return 2 ** (r["level"] + 1)
        return 1

    def band(self, o: Options, lenient: bool = False) -> Column:
        low, high = (1, self.n) if lenient and self.n < 5 else (o.min_df, int(o.max_df * self.n))
        return F.col("df").between(low, high)

    def stats(self, o: Options = Options()) -> DataFrame:
        """keyword, idf_score, document_frequency, total_documents inside the band; idf = ln((N + 1) / (df + 1))."""
        return self.df().where(self.band(o)).select(F.col("term").alias("keyword"), F.log((self.n + 1.0) / (F.col("df") + 1)).alias("idf_score"), F.col("df").alias("document_frequency"), F.lit(self.n).cast("long").alias("total_documents"))

    def keywords(self, o: Options = Options(), top: int | None = None) -> DataFrame:
        """issue_key, keyword, tfidf_score = tf (1 + ln(N / (1 + df))), tf_score = tf, idf_score as in stats; best ``top`` a document."""
        weight = F.col("tf") * (1 + F.log(F.lit(float(self.n)) / (1 + F.col("df"))))
        idf = F.log((self.n + 1.0) / (F.col("df") + 1))
        out = self.weighed(self.band(o)).select(F.col("doc").alias("issue_key"), F.col("term").alias("keyword"), weight.alias("tfidf_score"), F.col("tf").cast("double").alias("tf_score"), idf.alias("idf_score"))
        return best(out, top)

    def pure(self, o: Options = Options(max_df=0.5), top: int | None = None) -> DataFrame:
        """doc, term, tf = count / length, idf (1 for a single document), tfidf > 0."""
        idf = F.lit(1.0) if self.n == 1 else F.log((self.n + 1.0) / (F.col("df") + 1))
        out = self.weighed(self.band(o, lenient=True)).select("doc", "term", (F.col("tf") / F.col("len")).alias("tf"), idf.alias("idf")).withColumn("tfidf", F.col("tf") * F.col("idf"))
        out = out.where("tfidf > 0")
        if top is None:
            return out
        w = Window.partitionBy("doc").orderBy(F.desc("tfidf"), "term")
        return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")

    def pure_stats(self, o: Options = Options(max_df=0.5)) -> DataFrame:
        """term, idf, df inside the band, which holds for the smallest corpora too (unlike :meth:`pure`)."""
        idf = F.lit(1.0) if self.n == 1 else F.log((self.n + 1.0) / (F.col("df") + 1))
        return self.df().where(self.band(o)).select("term", idf.alias("idf"), "df")

    def light(self) -> DataFrame:
        """doc, term, score = count / length * ln(N / df), no filters."""
        return self.weighed().select("doc", "term", (F.col("tf") / F.col("len") * F.log(F.lit(float(self.n)) / F.col("df"))).alias("score"))

    def term_everywhere(self, docs: DataFrame, doc: str, term: str) -> DataFrame:
        """doc, score of one term in every document, 0 where it is absent; unfiltered."""
        hits = self.tf.where(F.col("term") == term)
        n = hits.count()
        score = F.col("tf") / F.col("len") * F.log(F.lit((self.n + 1.0) / (n + 1)))
        return docs.select(F.col(doc).alias("doc")).join(hits.select("doc", score.alias("s")), "doc", "left").select("doc", F.coalesce("s", F.lit(0.0)).alias("score"))

    def document_stats(self) -> DataFrame:
        return self.tf.groupBy("doc").agg(F.sum("tf").alias("term_count"), F.count(F.lit(1)).alias("unique_terms"), F.max("tf").alias("max_term_frequency"))

    def term_totals(self) -> DataFrame:
        return self.tf.groupBy("term").agg(F.sum("tf").alias("total_occurrences"), F.count(F.lit(1)).alias("document_frequency"))

    def info(self) -> DataFrame:
        """One row: total_documents, total_unique_terms, average_document_length."""
        return self.tf.agg(F.count_distinct("doc").alias("total_documents"), F.count_distinct("term").alias("total_unique_terms"), F.try_divide(F.sum("tf"), F.count_distinct("doc")).alias("average_document_length"))

    def health(self) -> DataFrame:
        """One row: score 0 to 100, 20 less for each finding, 0 without documents, and the findings."""
        i = self.info()
        terms, docs, length = F.col("total_unique_terms"), F.col("total_documents"), F.col("average_document_length")
        found = F.array_compact(F.array(F.when(docs == 0, "no documents"), F.when(terms < 0.1 * docs, "few terms"), F.when(length < 5, "short documents")))
        return i.select("*", found.alias("findings")).withColumn("score", F.when(docs == 0, 0).otherwise(F.greatest(F.lit(0), 100 - 20 * F.size("findings"))))


def best(scored: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        return scored
    w = Window.partitionBy("issue_key").orderBy(F.desc("tfidf_score"), "keyword")
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def _cosines(vectors: DataFrame, source, doc: str = "doc", term: str = "term", weight: str = "w") -> DataFrame:
    """doc, dot (null where no term is shared), similarity of every other document to ``source``, in one pass over the vectors."""
    w = F.col(weight)
    mine = written(vectors.where(F.col(doc) == source).groupBy(term).agg(F.sum(w).alias("mine")), "mine")
    norm = F.lit(mine.agg(F.sqrt(F.sum(F.col("mine") * F.col("mine"))).alias("n")).first()["n"] or 0.0)
    sums = vectors.where(F.col(doc) != source).join(checked(mine), term, "left").groupBy(doc).agg(F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * F.col("mine")).alias("dot"))
    return sums.select(doc, "dot", F.coalesce(F.try_divide("dot", F.col("norm") * norm), F.lit(0.0)).alias("similarity"))


def cosine_to(vectors: DataFrame, source, *, doc: str = "doc", term: str = "term", weight: str = "w") -> DataFrame:
    """doc, similarity of every other document to ``source``, 0 where no term is shared."""
    return _cosines(vectors, source, doc, term, weight).select(doc, "similarity")


def similar(vectors: DataFrame, source, top: int = 5) -> DataFrame:
    """The ``top`` documents nearest to ``source`` of those that share a term with it.

    Ties go by id; similarities that differ by no more than the order of their sums (those of copies) are ties.
    """
    near = _cosines(vectors, source).where(F.col("dot").isNotNull()).select("doc", "similarity")
    return near.orderBy(F.desc(F.round("similarity", 9)), "doc").limit(top)


def cosine(vectors: DataFrame, a, b) -> DataFrame:
    """One row: the cosine of two documents, 0 if either has no terms."""
    both = vectors.where(F.col("doc").isin(a, b)).groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("doc") == a, F.col("w"))), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.when(F.col("doc") == b, F.col("w"))), F.lit(0.0)).alias("y"))
    x, y = F.col("x"), F.col("y")
    return both.agg(F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), F.lit(0.0)).alias("similarity"))


def shared_top_terms(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """(doc, shared): how many of a document's ``top`` terms by two scorers (doc, term, score) are the same, for documents of both."""

    def best_of(scored: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 9)), "term")
        return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).groupBy("doc").agg(F.collect_set("term").alias(name))

    return best_of(a, "x").join(best_of(b, "y"), "doc").select("doc", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


@dataclass(frozen=True)
class Method:
    """A scorer (corpus, options) -> (doc, term, score) and what it can do."""

    score: Callable[[Corpus, Options], DataFrame]
    #: df band applied, terms of one document outside the band dropped, scores comparable over documents of different length
    banded: bool
    normalised: bool
    positive: bool


METHODS = {
    "library": Method(lambda c, o: c.keywords(o).select(F.col("issue_key").alias("doc"), F.col("keyword").alias("term"), F.col("tfidf_score").alias("score")), True, False, False),
    "pure": Method(lambda c, o: c.pure(o).select("doc", "term", F.col("tfidf").alias("score")), True, True, True),
    "light": Method(lambda c, o: c.light(), False, True, False),
}


def capabilities(spark: SparkSession) -> DataFrame:
    """One row a scorer: what it can do."""
    return spark.createDataFrame([(n, m.banded, m.normalised, m.positive) for n, m in METHODS.items()], "method string, banded boolean, normalised boolean, positive boolean")


def scores(corpus: Corpus, method: str = "library", options: Options = Options(), fallback: tuple[str, ...] = ()) -> DataFrame:
    """doc, term, score by the scorer named, or by the first of ``fallback`` that has any score where it has none."""
    for name in (method, *fallback):
        if name not in METHODS:
            raise ValueError(f"{name!r} is none of {', '.join(METHODS)}")
    out = METHODS[method].score(corpus, options)
    for name in fallback:
        if not out.isEmpty():
            break
        out = METHODS[name].score(corpus, options)
    return out


def with_fallback(first: Column, second: Column) -> Column:
    """Tokens of the first column, or of the second where the first has none."""
    return F.when(F.size(F.coalesce(first, F.array().cast("array<string>"))) > 0, first).otherwise(second)


def validation(corpus: Corpus, docs: DataFrame, doc: str, options: Options = Options()) -> DataFrame:
    """One row: documents given, documents with terms, terms in the band, and what is amiss."""
    given = docs.agg(F.count_distinct(doc).alias("given"))
    terms = corpus.stats(options).agg(F.count(F.lit(1)).alias("terms"))
    amiss = F.array_compact(F.array(F.when(F.col("given") != F.col("counted"), "documents without terms"), F.when(F.col("terms") == 0, "no statistics"), F.when(F.col("given") == 0, "no documents")))
    return given.join(terms).withColumn("counted", F.lit(corpus.n).cast("long")).withColumn("amiss", amiss)
