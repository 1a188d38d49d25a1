"""Incremental loads from a drop folder.

``checkpointLocation`` makes the loads resumable; each micro-batch writes a new
version of the tables beside the old one and moves a one-row pointer, so a batch
that is repeated after a failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvidex.operators.upsert import insert_comments, replace_attributes, upsert
from corvidex.sources import feed


class Versions:
    """Tables kept as version=N folders under a root; readers see the newest complete one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def newest(self, name: str, before: int | None = None) -> int | None:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/{name}")):
            return None
        found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(f"{self.root}/{name}")) if fs.exists(path(s.getPath().toString() + "/_SUCCESS"))]
        found = [v for v in found if before is None or v < before]
        return max(found, default=None)

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        v = self.newest(name, before)
        return None if v is None else self.spark.read.parquet(f"{self.root}/{name}/version={v}")

    def write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")


def load_items(items: DataFrame, versions: Versions, version: int) -> None:
    """Upsert issues, replace attributes of touched issues, add new comments."""
    if "item_pos" not in items.columns:
        items = items.withColumn("item_pos", F.monotonically_increasing_id())
    order = [F.col("source_file"), F.col("item_pos")]
    issues, attributes, comments = feed.issues_of(items), feed.attributes_of(items), feed.comments_of(items)
    for name, new, merge in (
        ("issues", issues, lambda old: upsert(old, issues, "key", order, keep=["id"])),
        ("custom_fields", attributes, lambda old: replace_attributes(old, attributes, issues.select(F.col("key").alias("issue_key")))),
        ("comments", comments, lambda old: insert_comments(old, comments, [*order, F.col("elem_pos")])),
    ):
        old = versions.read(name, before=version)
        versions.write(merge(new.limit(0) if old is None else old), name, version)


def ingest(spark: SparkSession, drop: str, root: str, checkpoint: str, *, per_trigger: int = 100) -> StreamingQuery:
    """Load whatever lies in the drop folder and stop; run again for what came later."""
    versions = Versions(spark, root)

    def batch(items: DataFrame, number: int) -> None:
        load_items(items, versions, number)

    return feed.stream_feed(spark, drop, per_trigger=per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_term_counts(docs: DataFrame, tokens: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Append (doc, term, tf) of each micro-batch; statistics are recomputed from the table, as every new document changes them all."""

    def batch(df: DataFrame, number: int) -> None:
        tokens(df).write.mode("overwrite").parquet(f"{root}/tf/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
