"""The tracker's tables as views over the synthetic tables.

issues from documents (created_at and status from the event of the same number),
attributes from labels, sources, page addresses and neighbours, comments from conversations.
The title is a title by construction: the first 80 characters; the description is the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(c: str):
    return F.concat(F.lit("DOC-"), F.expr(c).cast("string"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    # the title is cut before the join, so that plans without the description don't shuffle whole texts
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("project_key"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("description"))
    return docs.join(events, "doc_id", "left").select(key("doc_id").alias("issue_key"), "project_key", "title", "description", "status", "created_at", "doc_id")


def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue_key, title, description of :func:`issues` where no event is listed twice, without a join."""
    return table(spark, sf_dir, "documents").select(key("doc_id").alias("issue_key"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("description"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs, pages = (table(spark, sf_dir, n) for n in ("labels", "documents", "pages"))
    parts = [
        labels.select(key("doc_id").alias("issue_key"), F.lit("quality").alias("field_name"), F.col("quality").cast("string").alias("field_value")),
        labels.select(key("doc_id"), F.lit("toxic"), F.col("toxic").cast("string")),
        docs.select(key("doc_id"), F.lit("Work Group"), F.col("source")),
        pages.select(key("page_id"), F.lit("Related URL"), F.col("url")),
        docs.select(key("doc_id"), F.lit("Related Issues"), F.concat(key("doc_id + 1"), F.lit(", "), key("doc_id + 3"), F.lit(",,"), key("doc_id + 1"), F.lit(",GONE-1"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), key("conv_id").alias("issue_key"), F.col("role").alias("author"), F.col("text").alias("body"), "turn")


# The same views in SQL, as common table expressions.
ISSUES = "issues AS (SELECT 'DOC-' || d.doc_id AS issue_key, d.lang AS project_key, left(d.text, 80) AS title, d.text AS description, e.event_type AS status, e.ts AS created_at, d.doc_id FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"
ATTRIBUTES = (
    "attributes AS (SELECT 'DOC-' || doc_id AS issue_key, 'quality' AS field_name, quality::VARCHAR AS field_value FROM labels UNION ALL SELECT 'DOC-' || doc_id, 'toxic', toxic::VARCHAR FROM labels "
    "UNION ALL SELECT 'DOC-' || doc_id, 'Work Group', source FROM documents UNION ALL SELECT 'DOC-' || page_id, 'Related URL', url FROM pages "
    "UNION ALL SELECT 'DOC-' || doc_id, 'Related Issues', 'DOC-' || (doc_id + 1) || ', DOC-' || (doc_id + 3) || ',,DOC-' || (doc_id + 1) || ',GONE-1' FROM documents)"
)
COMMENTS = "comments AS (SELECT conv_id || '-' || turn AS comment_id, 'DOC-' || conv_id AS issue_key, role AS author, text AS body, turn FROM conversations)"
