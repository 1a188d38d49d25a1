"""Stores: discovery, catalog, snapshots, logs, manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.plans.shared import dealt, folder, shared_dir

# Where a store is looked for when no path is given, in this order.
FALLBACKS = ("./store", "../store", "./data/store", "../data/store")


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = folder(spark, path)
    return fs.exists(target)


def resolve_store(spark: SparkSession, path: str | None = None, option: str | None = None) -> str:
    """The explicit path, else the option, else the first fallback that exists."""
    for p in (path, option):
        if p:
            if not exists(spark, p):
                raise FileNotFoundError(p)
            return p
    for p in FALLBACKS:
        if exists(spark, p):
            return p
    raise FileNotFoundError("no store at " + ", ".join(FALLBACKS))


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def save_table(df: DataFrame, root: str, name: str, *, mode: str = "overwrite", sort: list[str] = (), by: list[str] = ()) -> None:
    """Write a table; ``sort`` keeps its rows clustered so that min/max statistics prune point lookups."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{name}")


def tables(spark: SparkSession, pattern: str = "*") -> list[str]:
    return [t.name for t in spark.catalog.listTables(pattern=pattern)]


def columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(name, type) of a table or view of the catalog."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def name_differences(expected: list[str], actual: list[str]) -> dict[str, list[str]]:
    """missing and extra names (tables or columns), each in its own order."""
    return {"missing": [x for x in expected if x not in actual], "extra": [x for x in actual if x not in expected]}


def version_of(spark: SparkSession, path: str) -> str:
    """A name for the present content of a file or folder: of its files' paths, lengths and times."""
    target, fs = folder(spark, path)
    found, files = [], fs.listFiles(target, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def size_of(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files at the paths."""
    return sum(fs.getContentSummary(target).getLength() for target, fs in (folder(spark, p) for p in paths))


def stored(spark: SparkSession, source: str | list[str], name: str, build: Callable[[], DataFrame], by: list[str]) -> DataFrame:
    """The table ``name`` derived from the files at ``source``: built and written on first use, read from then on.

    Rows are range-partitioned and sorted by ``by``, so that lookups by its first
    column skip files and row groups by their statistics, and a frequent value is
    spread over files; without ``by`` they stay where they are made, without a shuffle.
    The partitions grow in number with the sources, not in size. Changed source files
    give another table.
    """
    sources = [source] if isinstance(source, str) else source
    path = f"{shared_dir(spark)}/corvidex/store/{'-'.join(version_of(spark, x) for x in sources)}/{name}"
    target, fs = folder(spark, f"{path}/_SUCCESS")
    if not fs.exists(target):
        keys = [F.col(c) for c in by]
        with dealt(spark, size_of(spark, *sources)):
            rows = build()
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if by else rows
            rows.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)
    return spark.read.parquet(path)


def snapshot(df: DataFrame, root: str, name: str, version: str) -> str:
    path = f"{root}/snapshots/{name}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted, with the side."""
    cols = [F.col(f"`{c}`") for c in a.columns]
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("right")))


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Rows added as they are: loading the same rows twice doubles them."""
    df.write.mode("append").parquet(f"{root}/{name}")


def append_log(events: DataFrame, path: str, keep: int = 1000) -> None:
    """Add events to a JSON-lines log that holds the newest ``keep`` (by ts) in all: a ring by definition.

    The new state is written beside the old one, then takes its place.
    """
    spark = events.sparkSession
    target, fs = folder(spark, path)
    both = events.unionByName(spark.read.schema(events.schema).json(path)) if fs.exists(target) else events
    new, _ = folder(spark, f"{path.rstrip('/')}-new")
    both.orderBy(F.desc("ts"), *(F.col(c) for c in sorted(events.columns) if c != "ts")).limit(keep).write.mode("overwrite").json(new.toString())
    fs.delete(target, True)
    fs.rename(new, target)


def read_log(spark: SparkSession, path: str, schema: str, where: str = "true") -> DataFrame:
    """A JSON-lines log or a folder of JSON documents with a declared schema; lines that aren't JSON go."""
    kept = "_broken"
    line = F.from_json("value", f"{schema}, {kept} string", {"columnNameOfCorruptRecord": kept})
    return spark.read.text(path).select(line.alias("r")).select("r.*").where(F.col(kept).isNull()).drop(kept).where(where)


def manifest(results: DataFrame) -> DataFrame:
    """Counts over a table of (week_start, ok, rows) download results."""
    return results.agg(F.count(F.lit(1)).alias("weeks"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"))


def manifest_lines(results: DataFrame) -> DataFrame:
    """(line, text): the manifest as text, its counts first, then a line for each week in order, failures with their reason."""
    head = manifest(results).select(F.inline(F.array(*(F.struct(F.lit(-3 + i).cast("long").alias("line"), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")).alias("text")) for i, (name, c) in enumerate((("weeks", "weeks"), ("succeeded", "succeeded"), ("failed", "failed")))))))
    week = F.date_format("week_start", "yyyy-MM-dd")
    said = F.when(F.col("ok"), F.concat(week, F.lit(" ok "), F.col("rows").cast("string"), F.lit(" rows"))).otherwise(F.concat(week, F.lit(" failed "), F.coalesce("error", F.lit("?"))))
    return head.unionByName(results.select(F.unix_date("week_start").cast("long").alias("line"), said.alias("text")))


def pending(wanted: DataFrame, worklist: DataFrame, pattern: str = r"(?m)^### ([A-Z]+-\d+)$") -> DataFrame:
    """Items whose key has no heading in the work list yet."""
    done = worklist.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("issue_key")).distinct()
    return wanted.join(done, "issue_key", "left_anti")
