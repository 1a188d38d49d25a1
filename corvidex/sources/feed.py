"""XML issue feeds: reading, shredding, archives, week ranges."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.functions.dates import feed_time

_REF = "struct<`#text`:string,`@_id`:string>"
_PERSON = "struct<`#text`:string,`@_username`:string>"
ITEM = (
    "title string, link string, description string, summary string, created string, updated string, resolved string, watches string, "
    f"key {_REF}, project struct<`#text`:string,`@_id`:string,`@_key`:string>, type {_REF}, priority {_REF}, resolution {_REF}, "
    "status struct<`#text`:string,`@_id`:string,statusCategory:struct<`@_id`:string,`@_key`:string,`@_colorName`:string>>, "
    f"assignee {_PERSON}, reporter {_PERSON}, "
    "customfields struct<customfield:array<struct<`@_id`:string,`@_key`:string,customfieldname:string,"
    "customfieldvalues:struct<customfieldvalue:array<struct<`#text`:string,`@_key`:string>>>>>>, "
    "comments struct<comment:array<struct<`#text`:string,`@_id`:string,`@_author`:string,`@_created`:string>>>"
)
OPTIONS = {"rowTag": "item", "attributePrefix": "@_", "valueTag": "#text", "mode": "PERMISSIVE"}
FLOOR = "2015-07-13"
#: Items without a key go, with all that belongs to them.
HAS_KEY = "coalesce(key.`#text`, '') <> ''"


def read_feed(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """Items of all ``*.xml`` files under (or, not recursive, in) a folder; file and position order the load."""
    items = spark.read.format("xml").options(**OPTIONS, pathGlobFilter="*.xml", recursiveFileLookup=str(recursive).lower()).schema(ITEM).load(path)
    return items.withColumn("source_file", F.input_file_name()).withColumn("item_pos", F.monotonically_increasing_id())


def stream_feed(spark: SparkSession, path: str, *, per_trigger: int = 100) -> DataFrame:
    items = spark.readStream.format("xml").options(**OPTIONS, pathGlobFilter="*.xml", maxFilesPerTrigger=per_trigger).schema(ITEM).load(path)
    return items.withColumn("source_file", F.col("_metadata.file_path"))


def _id(path: str) -> Column:
    return F.col(path).try_cast("bigint")


def issues_of(items: DataFrame) -> DataFrame:
    """One record an item; items without a key go."""
    t = lambda c: F.col(f"{c}.`#text`")
    ref = lambda c: [_id(f"{c}.`@_id`").alias(f"{c}_id"), t(c).alias(c)]
    return items.where(HAS_KEY).select(
        t("key").alias("key"), _id("key.`@_id`").alias("id"), "title", "link", _id("project.`@_id`").alias("project_id"), F.col("project.`@_key`").alias("project_key"),
        "description", "summary", *ref("type"), *ref("priority"), *ref("status"), _id("status.statusCategory.`@_id`").alias("status_category_id"),
        F.col("status.statusCategory.`@_key`").alias("status_category_key"), F.col("status.statusCategory.`@_colorName`").alias("status_category_color"),
        *ref("resolution"), t("assignee").alias("assignee"), t("reporter").alias("reporter"), feed_time(F.col("created")).alias("created_at"), feed_time(F.col("updated")).alias("updated_at"),
        feed_time(F.col("resolved")).alias("resolved_at"), F.coalesce(F.col("watches").try_cast("bigint"), F.lit(0)).alias("watches"), "source_file", "item_pos",
    )


def attributes_of(items: DataFrame) -> DataFrame:
    """One row a custom field; several values joined by comma and space, structured ones as JSON."""
    key = F.col("key.`#text`")
    values = F.transform(F.col("f.customfieldvalues.customfieldvalue"), lambda v: F.coalesce(v["#text"], F.to_json(v)))
    return items.where(HAS_KEY).select(key.alias("issue_key"), "source_file", "item_pos", F.posexplode("customfields.customfield").alias("elem_pos", "f")).select(
        "issue_key", F.col("f.`@_id`").alias("field_id"), F.col("f.`@_key`").alias("field_key"), F.col("f.customfieldname").alias("field_name"), F.array_join(values, ", ").alias("field_value"), "source_file", "item_pos", "elem_pos",
    )


def comments_of(items: DataFrame) -> DataFrame:
    key = F.col("key.`#text`")
    return items.where(HAS_KEY).select(key.alias("issue_key"), "source_file", "item_pos", F.posexplode("comments.comment").alias("elem_pos", "c")).select(
        F.col("c.`@_id`").alias("comment_id"), "issue_key", F.col("c.`@_author`").alias("author"), feed_time(F.col("c.`@_created`")).alias("created_at"), F.col("c.`#text`").alias("body"), "source_file", "item_pos", "elem_pos",
    )


def extracted(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files in tar archives, the first folder level stripped; a file at a time leaves the worker."""

    def run(batches):
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame([(m.name.split("/", 1)[-1], tar.extractfile(m).read())], columns=["name", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, content binary")


def week_ranges(spark: SparkSession, today: str, floor: str = FLOOR, limit: int | None = None) -> DataFrame:
    """(week_start, week_end): weeks from Sunday, newest first, not before the floor; the current one ends today."""
    t, low = F.to_date(F.lit(today)), F.to_date(F.lit(floor))
    sunday = F.date_sub(t, F.dayofweek(t) - 1)
    first = F.date_sub(low, F.dayofweek(low) - 1)
    weeks = spark.range(1).select(F.explode(F.sequence(first, sunday, F.expr("interval 7 days"))).alias("s"))
    out = weeks.select(F.greatest("s", low).alias("week_start"), F.least(F.date_add("s", 6), t).alias("week_end")).orderBy(F.desc("week_start"))
    return out if limit is None else out.limit(limit)


def range_text(start: Column, end: Column, specification: str | None = None) -> Column:
    """The tracker's own predicate for a range of days."""
    day = lambda c, time: F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd"), F.lit(f" {time}'"))
    parts = [F.lit("updated <= "), day(end, "23:59"), F.lit(" and updated >= "), day(start, "00:00")]
    return F.concat(*([F.lit(f"Specification = '{specification}' and ")] if specification else []), *parts)


def request_url(base: str, predicate: Column, row_cap: int = 1000) -> Column:
    return F.concat(F.lit(base + "?jqlQuery="), F.url_encode(predicate), F.lit(f"&tempMax={row_cap}"))
