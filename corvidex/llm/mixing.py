"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

Every document gets the key ``u ** (1 / w)`` with a reproducible uniform ``u`` and
a document quality weight ``w``. Within its source, documents come in descending
key order; a source takes as many complete epochs as its token budget holds, then
a prefix of that order up to the rest of the budget. The document on which the
budget ends is taken in part, so a source meets its budget to the word.

Prefix sums don't sort a source in one task: keys fall into ``BINS`` equal bins,
bins are summed before any shuffle, and only the one bin in which the budget ends
is sorted. A hot source thus costs its partial sums plus 1/BINS of its rows.

Defined cases: null or empty texts have size 0 and take 0; a source of size 0 has
target 0; null is a source of its own, last in order; ties in the key go by
document id, then text hash, and rows alike in both share a place; no column name of the
input clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.llm.names import quoted, unused
from corvidex.plans.shared import as_text, dropped, join_small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Digits, marks and symbols of ASCII.
ODD = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"
#: Source weights in code point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
BINS = 4096
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 1.5: a half plus the share of characters that aren't digits, marks or symbols of ASCII, in any script alike. Debris and tables score low."""
    odd = F.regexp_count(text, F.lit(ODD))
    return F.when(F.length(text) == 0, 0.5).otherwise(1.5 - odd / F.length(text))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Reproducible, in (0, 1): 52 bits of an MD5 of seed, id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(src, source_size) -> also target: water filling by weight under a cap of ``cap`` times the size.

    One row a source. Each round is one small aggregate; a round that fixes no
    further source ends the loop, so there are at most as many as distinct
    size-to-weight ratios.
    """
    # one row a source: the rank needs the order of names only, spread over range partitions
    n = sizes.count()
    if n == 0:
        return sizes.withColumn("target", F.lit(0.0))
    ranked = written(ranks(sizes).withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "ranked")
    total = budget * ranked.agg(F.sum("source_size").alias("s")).first()["s"]
    level = None
    fixed = F.lit(False)
    before = -1
    while True:
        row = ranked.agg(
            F.count_if(fixed).alias("n"),
            F.coalesce(F.sum(F.when(fixed, cap * F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~fixed, F.col("w"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["n"] == before or row["w"] == 0:
            break
        before = row["n"]
        level = (total - row["full"]) / row["w"]
        fixed = level * F.col("w") >= cap * F.col("source_size")
    out = written(
        ranked.select("src", "source_size", F.when(fixed, cap * F.col("source_size").cast("double")).otherwise(F.lit(level or 0.0) * F.col("w")).alias("target")), "targets"
    )
    dropped(ranked)
    return out


def ranks(sizes: DataFrame) -> DataFrame:
    """0-based rank of ``src`` by code point, null last, without a one-task window.

    Sources are range-partitioned, ranked inside their partition and shifted by
    the counts of the partitions before (one row a partition).
    """
    order = [F.col("src").asc_nulls_last()]
    parted = written(sizes.repartitionByRange(8, *order).withColumn("part", F.spark_partition_id()), "parted")
    counts = {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, seen = [], 0
    for p in sorted(counts):
        shift += [F.lit(p), F.lit(seen)]
        seen += counts[p]
    start = F.element_at(F.create_map(*shift), F.col("part")).cast("long")
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + start)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, src, size, source_size, target, epochs, taken: one row a document."""
    body = as_text(F.col(quoted(text)))
    u, w = uniform(F.col(quoted(doc_id)), body, seed), quality_weight(body)
    keyed = written(
        docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("src"), words_in(body).alias("size"), F.pow(u, 1 / w).alias("key"), F.xxhash64(body).alias("tie")).withColumn(
            "bin", F.least(F.floor((1 - F.col("key")) * BINS), F.lit(BINS - 1)).cast("int")
        ),
        "keyed",
    )
    bins = written(keyed.groupBy("src", "bin").agg(F.sum("size").alias("words")), "bins")  # partial sums: at most BINS rows a source
    goal = targets(bins.groupBy("src").agg(F.sum("words").alias("source_size")), weights=weights, budget=budget, cap=cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "rest", F.when(F.col("epochs") >= cap, 0).otherwise(F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long")
    )
    # a struct key makes null sources equal in an ordinary join
    goal = goal.withColumn("k", F.struct("src")).drop("src")
    run = Window.partitionBy("src").orderBy("bin")
    ends = (
        bins.withColumn("before", F.sum("words").over(run) - F.col("words"))
        .withColumn("k", F.struct("src"))
        .join(goal.select("k", "rest"), "k")
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .groupBy("k")
        .agg(F.min(F.struct("bin", "before")).alias("end"))
    )
    plan = written(goal.join(ends, "k", "left").select("k", "source_size", "target", "epochs", "rest", "end.bin", "end.before").withColumnRenamed("bin", "end_bin"), "plan")
    rows = join_small(keyed.withColumn("k", F.struct("src")), plan, ["k"])
    end = F.col("end_bin")
    whole = F.col("epochs") * F.col("size")
    # no end bin: the rest is the whole source or the source is empty
    sure = rows.where(end.isNull() | (F.col("bin") != end)).withColumn("extra", F.when(end.isNull() & (F.col("rest") >= F.col("source_size")) | (F.col("bin") < end), F.col("size")).otherwise(0))
    inside = Window.partitionBy("src").orderBy(F.col("key").desc(), F.col("doc_id"), F.col("tie"))
    last = (
        rows.where(F.col("bin") == end)
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size")))))
        .drop("upto")
    )
    cols = ["doc_id", "src", "size", "source_size", "target", "epochs", (whole + F.col("extra")).cast("long").alias("taken"), "tie"]
    return sure.select(*cols).unionByName(last.select(*cols))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mixed corpus: every document as often as taken, with the columns of ``docs``.

    A document taken in part gives its leading words up to the budget as a last copy
    (one document a source at most). Rows of size 0 are not taken.
    """
    taken = mix(docs, doc_id=doc_id, text=text, source=source).where("taken > 0")
    own, size, words, rows_, part_ = unused(docs, "key", "size", "words", "rows", "part")
    take = written(
        taken.groupBy(F.struct("doc_id", "src", "tie").alias(own)).agg(F.max("size").alias(size), F.sum("taken").alias(words), F.count(F.lit(1)).alias(rows_)), "taken"
    )
    body = F.col(quoted(text))
    key = F.struct(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("src"), F.xxhash64(as_text(body)).alias("tie"))
    rows = join_small(docs.withColumn(own, key), take, [own], "inner")
    if not take.where(F.col(rows_) > 1).isEmpty():  # repeated rows: one of them stands for all copies
        rows = rows.where(F.col(rows_) == 1).unionByName(rows.where(F.col(rows_) > 1).dropDuplicates([own]))
    part = (F.col(words) % F.col(size)).cast("int")
    whole = F.array_repeat(F.lit(0), F.floor(F.col(words) / F.col(size)).cast("int"))
    copies = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    pieces = F.regexp_extract_all(body, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    lead = F.concat(F.regexp_extract(body, r"^[\x20\x09-\x0D]*", 0), F.array_join(F.slice(pieces, F.lit(1), F.col(part_)), ""))
    out = rows.withColumn(part_, F.explode(copies)).withColumn(text, F.when(F.col(part_) > 0, lead).otherwise(body))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(part_) > 0, F.length(body).cast("long")).otherwise(F.col(quoted(n_chars))))
    return out.select(*(F.col(quoted(c)) for c in docs.columns))
