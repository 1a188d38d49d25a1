"""The read-only tools: listing, search, related items, details."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.clean import url_stem
from corvidex.operators import fts
from corvidex.operators.upsert import attribute_map
from corvidex.plans.shared import BROADCAST_ROWS

# The columns of a search without named fields.
SEARCH_FIELDS = ["title", "description", "summary", "resolution_description"]
FILTERS = ("project_key", "work_group", "resolution", "status", "assignee")
LISTS = ("related_url", "related_artifacts", "related_pages")


def filtered(df: DataFrame, **equal: str | None) -> DataFrame:
    """Conjunction of equalities; absent or empty values don't filter."""
    for c, v in equal.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


def list_items(df: DataFrame, *, order: str = "issue_int", key: str = "issue_key", limit: int = 50, offset: int = 0, **equal: str | None) -> DataFrame:
    """A page of matching items, largest ``order`` first."""
    return filtered(df, **equal).orderBy(F.desc(order), key).offset(offset).limit(limit)


def with_hits(df: DataFrame, hits: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Rows of ``df`` whose issue_key is the ``key`` of a hit; a hit list bounded by ``limit`` is broadcast, an unbounded one shuffled."""
    side = hits.withColumnRenamed(key, "_hit")
    return df.join(F.broadcast(side) if limit is not None and limit <= BROADCAST_ROWS else side, df["issue_key"] == F.col("_hit")).drop("_hit")


def search_items(df: DataFrame, post: DataFrame, query: str, *, fields: list[str] | None = None, limit: int | None = 50, order: str = "best", sizes: DataFrame | None = None) -> DataFrame:
    """Whole rows of the matching items with their rank."""
    hits = fts.search_any_column(post, query, fields or SEARCH_FIELDS, limit, order=order, sizes=sizes)
    return with_hits(df, hits, "doc", limit).orderBy(F.asc("rank") if order == "best" else F.desc("rank"), "issue_key")


def like_terms(value: str | None, field: str, *, keep_empty: bool = False) -> list[str]:
    """Trimmed parts of a comma list; empty ones match everything and go unless asked for."""
    parts = [x.strip() for x in (value or "").split(",")]
    return [x for x in parts if x or keep_empty]


def field_condition(values: dict[str, str | None], *, keep_empty: bool = False) -> Column | None:
    """Any part within a field, all fields."""
    groups = []
    for field in LISTS:
        terms = like_terms(values.get(field), field, keep_empty=keep_empty)
        if terms:
            wanted = [url_stem(F.lit(t)) if field == "related_url" else F.lit(t) for t in terms]
            groups.append(reduce(or_, [F.ilike(F.col(field), F.concat(F.lit("%"), w, F.lit("%"))) for w in wanted]))
    return reduce(and_, groups) if groups else None


def merged(*lists: DataFrame, drop: str | None = None, limit: int | None = None) -> DataFrame:
    """issue_key lists (with a column pos) one after the other, first sight counts; order kept in src, pos."""
    rows = None
    for i, x in enumerate(lists):
        x = x.select("issue_key", F.lit(i).alias("src"), F.col("pos").cast("long").alias("pos"))
        rows = x if rows is None else rows.unionByName(x)
    out = rows.groupBy("issue_key").agg(F.min(F.struct("src", "pos")).alias("o")).select("issue_key", "o.src", "o.pos")
    if drop is not None:
        out = out.where(F.col("issue_key") != drop)
    out = out.orderBy("src", "pos", "issue_key")
    return out if limit is None else out.limit(limit)


def related_keys(df: DataFrame, post: DataFrame, key: str, linked: DataFrame, keywords: str | None = None, limit: int | None = 10, *, sizes: DataFrame | None = None) -> DataFrame:
    """Linked keys first, then items alike in project, group and related fields, then keyword matches."""
    row = df.where(F.col("issue_key") == key).limit(1).first()
    if row is None:
        raise LookupError(key)
    same = filtered(df, project_key=row["project_key"], work_group=row["work_group"]).where(F.col("issue_key") != key)
    more = field_condition({f: row[f] for f in LISTS if f in df.columns})
    same = same.where(more) if more is not None else same
    if limit is not None:
        same = same.orderBy(F.desc("issue_int"), "issue_key").limit(limit)
    same = same.select("issue_key", (-F.col("issue_int")).alias("pos"))
    parts = [linked.select("issue_key", "pos"), same]
    if keywords:
        hits = fts.search_any_column(post, keywords, SEARCH_FIELDS, limit, sizes=sizes)
        parts.append(hits.select(F.col("doc").alias("issue_key"), F.floor(F.col("rank") * 1e9).cast("long").alias("pos")))
    return merged(*parts, drop=key, limit=limit)


def find_related(df: DataFrame, post: DataFrame, key: str, linked: DataFrame, keywords: str | None = None, limit: int | None = 10, *, sizes: DataFrame | None = None) -> DataFrame:
    """As :func:`related_keys`, with whole rows; keys without an item go."""
    keys = related_keys(df, post, key, linked, keywords, limit, sizes=sizes)
    return with_hits(df, keys, "issue_key", limit).orderBy("src", "pos", "issue_key")


def rows_in_order(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` for (issue_key, pos) in the order of pos, as often as a key is listed; keys without an item go."""
    return keys.join(df, "issue_key").orderBy("pos")


def linked_keys(attributes: DataFrame, key: str, name: str = "Related Issues") -> DataFrame:
    """issue_key, pos of the comma list in an item's attribute, empty parts out."""
    rows = attributes.where((F.col("issue_key") == key) & (F.col("field_name") == name)).limit(1)
    return rows.select(F.posexplode(F.split("field_value", ",")).alias("pos", "k")).select(F.trim("k").alias("issue_key"), "pos").where("issue_key <> ''")


def keyword_query(keywords: DataFrame, key: str, top: int = 3) -> DataFrame:
    """One row: the item's strongest keywords joined by OR."""
    own = keywords.where(F.col("issue_key") == key).orderBy(F.desc("tfidf_score"), "keyword").limit(top)
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("tfidf_score")).alias("s"), "keyword"))), lambda x: x["keyword"]), " OR ").alias("query"))


def details(df: DataFrame, attributes: DataFrame, comments: DataFrame, order: list[Column], key: str | None = None) -> DataFrame:
    """Rows with custom_fields and comment_count: of one item, or of all in one plan."""
    one = (lambda x: x.where(F.col("issue_key") == key)) if key is not None else (lambda x: x)
    counts = one(comments).groupBy("issue_key").agg(F.count(F.lit(1)).alias("comment_count"))
    out = one(df).join(attribute_map(one(attributes), order), "issue_key", "left").join(counts, "issue_key", "left")
    return out.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def item_comments(comments: DataFrame, key: str) -> DataFrame:
    return comments.where(F.col("issue_key") == key).orderBy(F.desc_nulls_last("created_at"), "comment_id")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def as_json(df: DataFrame) -> DataFrame:
    """One column json: a row as a JSON object with all its fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def any_key(df: DataFrame, key: str = "issue_key") -> DataFrame:
    """One row: a key of the table, the smallest, so that reruns agree."""
    return df.agg(F.min(key).alias(key))
