"""Incremental writes as functions (existing, batch) -> new table, and the pivot to the wide view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions.clean import clean_attribute, numeric_suffix

# Attributes that become columns of the wide view.
PROMOTED = {
    "Resolution Description": "resolution_description",
    "Work Group": "work_group",
    "Change Category": "change_category",
    "Change Impact": "change_impact",
    "Related URL": "related_url",
    "Related Artifact(s)": "related_artifacts",
    "Related Page(s)": "related_pages",
}


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(existing: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first writer of a key wins."""
    new = first_rows(batch, [key], order).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def insert_comments(existing: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """As above on comment_id, but rows without one are never equal and all stay."""
    anonymous = batch.where("comment_id is null")
    return insert_or_ignore(existing, batch.where("comment_id is not null"), "comment_id", order).unionByName(anonymous.select(*existing.columns))


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: list[Column], keep: list[str] = ()) -> DataFrame:
    """The last writer wins all columns but ``keep``, which stay as first written. One shuffle by key."""
    both = existing.select("*", F.lit(0).alias("_gen"), F.lit(0).alias("_ord")).unionByName(
        batch.withColumn("_ord", F.row_number().over(Window.partitionBy(key).orderBy(*order))).select(*existing.columns, F.lit(1).alias("_gen"), "_ord")
    )
    rest = [c for c in existing.columns if c != key and c not in keep]
    age = F.struct("_gen", "_ord")
    row = both.groupBy(key).agg(F.max_by(F.struct(*rest), age).alias("_new"), *(F.min_by(c, age).alias(c) for c in keep))
    return row.select(key, "_new.*", *keep).select(*existing.columns)


def replace_attributes(existing: DataFrame, batch: DataFrame, touched: DataFrame, key: str = "issue_key") -> DataFrame:
    """All attributes of touched items give way to those of the batch."""
    return existing.join(touched.select(key).distinct(), key, "left_anti").unionByName(batch.select(*existing.columns))


def pivoted(attributes: DataFrame, order: list[Column], names: dict[str, str] = PROMOTED) -> DataFrame:
    """One row an item: the first value of each promoted name by load order. One aggregate, no self-joins."""
    age = F.struct(*order)
    picked = attributes.where(F.col("field_name").isin(*names))
    return picked.groupBy("issue_key").agg(*(F.min_by(F.when(F.col("field_name") == n, F.col("field_value")), F.when(F.col("field_name") == n, age)).alias(c) for n, c in names.items()))


def pivoted_by_joins(issues: DataFrame, attributes: DataFrame, names: dict[str, str] = PROMOTED) -> DataFrame:
    """Strict form: a left join a name, so duplicate names multiply rows."""
    out = issues
    for n, c in names.items():
        out = out.join(attributes.where(F.col("field_name") == n).select("issue_key", F.col("field_value").alias(c)), "issue_key", "left")
    return out


def wide(issues: DataFrame, attributes: DataFrame, order: list[Column], names: dict[str, str] = PROMOTED) -> DataFrame:
    """Issues with promoted attributes, cleaned, and the numeric suffix of the key."""
    joined = issues.join(pivoted(attributes, order, names), "issue_key", "left")
    out = joined.withColumn("issue_int", numeric_suffix(F.col("issue_key")))
    for c in names.values():
        out = out.withColumn(c, clean_attribute(F.col(c)))
    return out


def attribute_map(attributes: DataFrame, order: list[Column]) -> DataFrame:
    """issue_key, custom_fields map; of duplicate names the last counts."""
    last = attributes.groupBy("issue_key", "field_name").agg(F.max_by("field_value", F.struct(*order)).alias("v"))
    return last.groupBy("issue_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "v")))).alias("custom_fields"))


def with_comment_text(issues: DataFrame, comments: DataFrame, order: Column) -> DataFrame:
    """Comments joined by comma in order, counted before the join so that rows don't multiply."""
    text = comments.groupBy("issue_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("body").alias("b")))), lambda x: x["b"]), ",").alias("comments"), F.count(F.lit(1)).alias("comment_count"))
    return issues.join(text, "issue_key", "left").withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def document_text(parts: list[Column]) -> Column:
    """Non-blank parts joined by one space; kept parts aren't trimmed."""
    return F.concat_ws(" ", *(F.when(F.trim(p) != "", p) for p in parts))


def processor_text(issues: DataFrame, attributes: DataFrame, columns: list[str]) -> DataFrame:
    """issue_key, text: the named columns of an issue and every one of its attribute values, the non-blank ones joined by one space."""
    values = attributes.where(F.trim("field_value") != "").groupBy("issue_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("field_name", "field_value"))), lambda x: x["field_value"]).alias("values"))
    own = document_text([F.col(c) for c in columns])
    rows = issues.join(values, "issue_key", "left")
    return rows.select("issue_key", F.concat_ws(" ", F.when(own != "", own), F.array_join("values", " ")).alias("text"))
