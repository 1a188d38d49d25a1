"""Queries over the keyword table (issue_key, keyword, tfidf_score, tf_score, idf_score) and the issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions.dates import period


def _named(c: Column, words: list[str], ignore_case: bool) -> Column:
    return F.lower(c).isin(*(w.lower() for w in words)) if ignore_case else c.isin(*words)


def issue_keywords(keywords: DataFrame, key: str, limit: int = 10) -> DataFrame:
    return keywords.where(F.col("issue_key") == key).orderBy(F.desc("tfidf_score"), "keyword").limit(limit).select("keyword", "tfidf_score", "tf_score", "idf_score")


def search(keywords: DataFrame, words: str | list[str], limit: int = 20, *, ignore_case: bool = False) -> DataFrame:
    """issue_key, matching_keywords, total_score, match_count: most matches first."""
    words = [words] if isinstance(words, str) else words
    hits = keywords.where(_named(F.col("keyword"), words, ignore_case)).groupBy("issue_key")
    out = hits.agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("matching_keywords"), F.sum("tfidf_score").alias("total_score"), F.count_distinct("keyword").alias("match_count"))
    return out.orderBy(F.desc("match_count"), F.desc("total_score"), "issue_key").limit(limit)


def similar_issues(keywords: DataFrame, issues: DataFrame, key: str, limit: int = 10, source_top: int = 20) -> DataFrame:
    """Weighted overlap with the source's strongest keywords; its side of the join has at most ``source_top`` rows."""
    mine = issue_keywords(keywords, key, source_top).select("keyword", F.col("tfidf_score").alias("weight"))
    hits = keywords.where(F.col("issue_key") != key).join(F.broadcast(mine), "keyword")
    found = hits.groupBy("issue_key").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("common_keywords"), F.sum(F.col("tfidf_score") * F.col("weight")).alias("similarity_score"), F.count_distinct("keyword").alias("common_count"))
    return found.join(issues.select("issue_key", "title", "status"), "issue_key").orderBy(F.desc("similarity_score"), "issue_key").limit(limit)


def trends(keywords: DataFrame, issues: DataFrame, word: str, unit: str = "month", *, ignore_case: bool = False) -> DataFrame:
    """period, issue_count, avg_score, max_score."""
    hits = keywords.where(_named(F.col("keyword"), [word], ignore_case)).join(issues.select("issue_key", "created_at"), "issue_key")
    return hits.groupBy(period(F.col("created_at"), unit).alias("period")).agg(F.count_distinct("issue_key").alias("issue_count"), F.avg("tfidf_score").alias("avg_score"), F.max("tfidf_score").alias("max_score")).orderBy("period")


def project_keywords(keywords: DataFrame, issues: DataFrame, project: str, limit: int = 20) -> DataFrame:
    own = issues.where(F.col("project_key") == project).select("issue_key")
    out = keywords.join(own, "issue_key").groupBy("keyword").agg(F.count_distinct("issue_key").alias("issue_count"), F.avg("tfidf_score").alias("avg_score"), F.sum("tfidf_score").alias("total_score"))
    return out.orderBy(F.desc("issue_count"), F.desc(F.round("total_score", 9)), "keyword").limit(limit)


def top_keywords(keywords: DataFrame, limit: int = 20) -> DataFrame:
    out = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"), F.avg("tfidf_score").alias("avg_score"), F.max("tfidf_score").alias("max_score"))
    return out.orderBy(F.desc("frequency"), "keyword").limit(limit)


def cooccurrence(keywords: DataFrame, top: int = 50) -> DataFrame:
    """keyword_a, keyword_b, count of documents with both, over the ``top`` most frequent; pairs within one document only."""
    rank = F.row_number().over(Window.orderBy(F.desc("frequency"), "keyword"))
    ranked = top_keywords(keywords, top).select("keyword", rank.alias("r"))
    own = keywords.select("issue_key", "keyword").join(F.broadcast(ranked), "keyword").distinct()
    lists = own.groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("r", "keyword"))).alias("k"))  # at most ``top`` a document
    pairs = F.flatten(F.transform("k", lambda a: F.transform(F.filter(F.col("k"), lambda b: b["r"] > a["r"]), lambda b: F.struct(a["keyword"].alias("keyword_a"), b["keyword"].alias("keyword_b")))))
    return lists.select(F.inline(pairs)).groupBy("keyword_a", "keyword_b").agg(F.count(F.lit(1)).alias("count"))


def stats(keywords: DataFrame) -> DataFrame:
    """One row: total_keywords, unique_keywords, total_issues, avg_keywords_per_issue."""
    return keywords.agg(
        F.count(F.lit(1)).alias("total_keywords"), F.count_distinct("keyword").alias("unique_keywords"), F.count_distinct("issue_key").alias("total_issues"), F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("issue_key")).alias("avg_keywords_per_issue")
    )


def top_by_score(keywords: DataFrame, min_issues: int = 5, limit: int = 10) -> DataFrame:
    out = keywords.groupBy("keyword").agg(F.avg("tfidf_score").alias("avg_score"), F.count_distinct("issue_key").alias("issue_count"))
    return out.where(F.col("issue_count") >= min_issues).orderBy(F.desc(F.round("avg_score", 9)), "keyword").limit(limit)


def visualization(keywords: DataFrame, limit: int = 100) -> DataFrame:
    """nodes: id, label, value, score; most frequent first."""
    out = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("value"), F.avg("tfidf_score").alias("score"))
    return out.orderBy(F.desc("value"), "keyword").limit(limit).select(F.col("keyword").alias("id"), F.col("keyword").alias("label"), "value", "score")


def chart(keywords: DataFrame, limit: int = 100) -> DataFrame:
    """One row: nodes array and metadata struct."""
    nodes = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), "id", "label", "value", "score")))
    meta = F.struct(F.count(F.lit(1)).alias("totalKeywords"), F.max("value").alias("maxFrequency"), F.min("value").alias("minFrequency"))
    return visualization(keywords, limit).agg(F.transform(nodes, lambda n: n.dropFields("o")).alias("nodes"), meta.alias("metadata"))
