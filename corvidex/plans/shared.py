"""Tables written to the folder that driver and executors share.

A written table cuts lineage like ``checkpoint()`` but stays columnar, so later
reads prune columns and rows, and a lost executor costs nothing but a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast if it has at most this many rows and bytes of values.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Under :func:`dealt`, shuffles have a partition for so many bytes of input at least, and a task of a scan reads so many at most.
SHARE_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one of our own only where none is set and all tasks run in this very process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvidex-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, path: str):
    """(path, file system) of the JVM for a path in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str = "table", *, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema.

    The shuffle files of that one execution go when it ends, as nothing reads them
    again; a chain of written tables holds one step's shuffles on disk, not all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvidex/{uuid.uuid4().hex}-{label}"
    before = spark.conf.get(CLEANUP, None)
    if before is not None:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvidex_path = path
    return out


def shares(spark: SparkSession, size: int) -> int:
    """Partitions for shuffles of what ``size`` bytes of input make; the session's number where that is larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES))


@contextmanager
def dealt(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs inside over ``size`` bytes of input is dealt so that a task's share, and with it its memory, stays the same as inputs grow."""
    most = min(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes(), SHARE_BYTES)
    put = {"spark.sql.shuffle.partitions": str(shares(spark, size)), "spark.sql.files.maxPartitionBytes": str(most)}
    before = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing lazy still reads."""
    for df in tables:
        path = getattr(df, "_corvidex_path", None)
        if path:
            target, fs = folder(df.sparkSession, path)
            fs.delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that :func:`written` left in the shared folder; results not yet collected need them."""
    target, fs = folder(spark, f"{shared_dir(spark)}/corvidex")
    fs.delete(target, True)


def value_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row: 8 each, and as many as it has for text, binary and nested ones."""
    out = F.lit(8 * len(df.columns))
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col("`" + f.name.replace("`", "``") + "`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("struct", "array", "map"):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a *written* narrow table has at most ``limit`` rows and ``most`` bytes of values (one cheap aggregate)."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(value_bytes(df)), F.lit(0)).alias("bytes")).first()
    return n["rows"] <= limit and n["bytes"] <= most


def checked(df: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if :func:`small`, else as it is."""
    return F.broadcast(df) if small(df) else df


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a wide table with a narrow written one: broadcast when its counted size allows, else shuffle.

    The shuffled form relies on adaptive execution to split skewed partitions.
    """
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


def arrow_batches(spark: SparkSession, rows: int = 256, mb: int = 32) -> None:
    """Lower the session's bounds of Arrow batches sent to Python workers to these rows and bytes (long texts).

    Lazy results read the settings when they run, so they stay; narrower ones of the session's own are kept.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def as_text(c: Column | str) -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
