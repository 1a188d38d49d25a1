"""Connected components over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvidex.plans.shared import dropped, written


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component): component is the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours,
    then the label of that label (pointer jumping), so rounds grow with the logarithm
    of the diameter in most graphs. Only labels that changed decide the end; a round
    is one aggregate and one join on written tables. Isolated nodes are not edges and
    so not in the result; a self-loop (a, a) puts one in.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        # the smallest label among neighbours, one aggregate with partial minima
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        # hooking: the node that a label names hears of smaller labels too
        step = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "heard").alias("low"))
        hooks = step.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("low"))
        merged = written(
            step.select("node", "label", "low").join(hooks.withColumnRenamed("low", "hook"), "node", "left").select("node", "label", F.least("low", F.coalesce("hook", "low")).alias("low")), "step"
        )
        jump = merged.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = written(merged.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("next"), "label"), "labels")
        changed = not new.where("next <> label").isEmpty()
        dropped(labels, merged)
        labels_next = new.select("node", F.col("next").alias("label"))
        labels_next._corvidex_path = new._corvidex_path
        labels = labels_next
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    dropped(both)
    return labels.select("node", F.col("label").alias("component"))


def groups_by_value(rows: DataFrame, item: str, value: str) -> DataFrame:
    """(item, value) -> (item, group): items that share a value, directly or through others, share a group (its smallest item).

    A value with many items makes a star on its smallest item, so edges are as many
    as rows whatever the skew. Items need a type that compares; groups are exact.
    """
    pairs = rows.select(F.col(item).alias("a"), F.col(value).alias("v")).where("a is not null and v is not null").distinct()
    hubs = pairs.groupBy("v").agg(F.min("a").alias("b"))
    found = connected_components(pairs.join(hubs, "v").select("a", "b"))
    every = rows.select(F.col(item).alias("node")).where("node is not null").distinct()
    return every.join(found, "node", "left").select(F.col("node").alias(item), F.coalesce("component", "node").alias("group"))


def connected_values(rows: DataFrame, item: str, value: str, top: int = 10, *, with_items: bool = False) -> DataFrame:
    """value, n (and, if wanted, items in order): the ``top`` values that most items have, of those with two items or more; ties by value.

    Counts leave each task as partial sums; item lists are gathered for the ``top`` values only.
    """
    pairs = rows.select(F.col(item).alias("item"), F.col(value).alias("value")).where("item is not null and value is not null").distinct()
    best = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(top)
    if not with_items:
        return best
    lists = pairs.join(F.broadcast(best), "value").groupBy("value", "n").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return lists.orderBy(F.desc("n"), "value")


def dealt_batches(groups: DataFrame, group: str, size: str, batch: int) -> DataFrame:
    """(group, size) -> group, size, batch, from, to: as :func:`packed_batches`, for any number of groups.

    Groups of one size are interchangeable, so the plan is made on the histogram of sizes up to
    ``batch`` (one pass over it on the driver) and each group finds its place by its rank within
    its size: its place in its range partition plus the counts of the partitions before.
    """
    rows = groups.select(F.col(group).alias("group"), F.col(size).cast("long").alias("size")).where("size > 0")
    parted = written(rows.repartitionByRange(F.desc("size"), F.col("group")).withColumn("part", F.spark_partition_id()), "sizes")
    large = parted.where(F.col("size") > batch)
    counts = sorted(((r["size"], r["part"], r["n"]) for r in parted.where(F.col("size") <= batch).groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (-r[0], r[1]))
    before: dict[int, int] = {}
    shifts = []
    for n, part, k in counts:
        shifts.append((n, part, before.get(n, 0)))
        before[n] = before.get(n, 0) + k
    starts, at, used = [], 0, 0
    for n in sorted(before, reverse=True):  # first: how many still go into the open batch, each: how many into a new one
        first, each = (batch - used) // n, batch // n
        starts.append((n, at, first, each))
        rest = before[n] - first
        at, used = (at, used + n * before[n]) if rest <= 0 else (at + -(-rest // each), n * (rest - (-(-rest // each) - 1) * each))
    spark = groups.sparkSession
    rank = F.row_number().over(Window.partitionBy("size", "part").orderBy("group")) - 1
    ranked = parted.where(F.col("size") <= batch).withColumn("rank", rank)
    ranked = ranked.join(F.broadcast(spark.createDataFrame(shifts, "size long, part int, shift long")), ["size", "part"]).join(F.broadcast(spark.createDataFrame(starts, "size long, at long, first long, each long")), "size")
    nth = F.col("rank") + F.col("shift")
    number = F.when(nth < F.col("first"), F.col("at")).otherwise(F.col("at") + 1 + F.floor((nth - F.col("first")) / F.col("each")))
    small = ranked.select("group", "size", number.cast("long").alias("batch"), F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    # a group larger than a batch has batches of its own, numbered from -1 down
    cut = large.select("group", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(batch).cast("long"))).alias("from"))
    own = cut.withColumn("batch", -1 - (F.xxhash64("group", "from").bitwiseAND(F.lit((1 << 62) - 1)))).withColumn("to", F.least(F.col("from") + batch, F.col("size")))
    return small.unionByName(own.select("group", "size", "batch", "from", "to"))


def packed_batches(sizes: list[tuple[object, int]], batch: int) -> list[list[tuple[object, int, int]]]:
    """Groups (name, size) into batches of ``batch`` items: largest first, a group larger than a batch split, else never; (name, from, to)."""
    out: list[list[tuple[object, int, int]]] = []
    current: list[tuple[object, int, int]] = []
    used = 0
    for name, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        if size > batch:
            out += [[(name, at, min(at + batch, size))] for at in range(0, size, batch)]
            continue
        if used + size > batch:
            out.append(current)
            current, used = [], 0
        current.append((name, 0, size))
        used += size
    return [*out, current] if current else out
