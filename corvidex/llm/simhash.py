"""SimHash fingerprints and their search by permuted block tables; DataFrame operations only.

Fingerprint: every word votes with the bits of its 64-bit hash, weighted by the
square of its length (long words tell texts apart, short ones are everywhere), words of
``LONG`` letters or more alike; a bit is set where the weighted votes for it outweigh
those against. Votes are added in 32 sums of two 32-bit lanes each, inside generated
code, over rows that are already together by document, so no vote crosses the network.
Lanes hold the votes of ``PART`` words; the parts of longer texts are added up after.

Search: the 64 bits fall into 6 blocks; two fingerprints within 3 bits agree on at
least 3 blocks, so one table for each of the 20 choices of 3 blocks (a key of 31 to
33 bits) meets every such pair. A pair is reported by the first table that holds it
and by no other. Equal fingerprints are one entry with a count, so a group of
copies never multiplies.

Defined cases: null texts are empty; an empty text has the fingerprint 0 (no
votes); equal texts have equal fingerprints; rows equal in id and text count as one
document with several results; null ids come first; a single document is its own
next one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.plans.shared import as_text, written

BITS = 64
LANE = 4294967297  # bits 0 and 32
LONG, PART = 16, 1 << 23  # LONG ** 2 * PART stays below 2 ** 32
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 3
BLANKS = r"[\x20\x09-\x0D]+"


def votes(rows: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """keys, fp: the fingerprint of the words of each key. ``rows`` must lie together by ``keys`` for this not to shuffle."""
    n = F.least(F.length("w"), F.lit(LONG))
    said = rows.select(*keys, F.posexplode(words).alias("at", "w")).select(*keys, F.floor(F.col("at") / PART).cast("int").alias("part"), F.xxhash64("w").alias("h"), (n * n).cast("long").alias("v"))
    lanes = said.groupBy(*keys, "part").agg(F.sum("v").alias("all"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANE)) * F.col("v")).alias(f"s{j}") for j in range(32)))
    low = [F.sum(F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{j}") for j in range(32)]
    high = [F.sum(F.shiftrightunsigned(f"s{j}", 32)).alias(f"b{j + 32}") for j in range(32)]
    total = lanes.groupBy(*keys).agg(F.sum("all").alias("all"), *low, *high)
    bit = F.lit(0).cast("long")
    for j in range(BITS):
        bit = bit.bitwiseOR(F.shiftleft(F.when(2 * F.col(f"b{j}") > F.col("all"), F.lit(1)).otherwise(F.lit(0)).cast("long"), j))
    return total.select(*keys, bit.alias("fp"))


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), BLANKS)


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def in_order(docs: DataFrame) -> DataFrame:
    """(k1, k2, n) rows with doc_id -> k1, k2, n, next1, next2, prev1, prev2, prev_n: neighbours by ascending id, round the end.

    Ids are range-partitioned and looked up inside their partition; across the
    edges helps the list of first and last rows, one of each a partition.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["doc_id", "k1", "k2"]
    ids = written(docs.distinct().repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "ids")
    entry = F.struct("doc_id", "k1", "k2", "n")
    edges = sorted(ids.groupBy("part").agg(F.min(entry).alias("a"), F.max(entry).alias("b")).collect(), key=lambda r: r["part"])
    here = Window.partitionBy("part").orderBy(*by)
    out = ids.withColumn("e", F.struct("k1", "k2", "n")).withColumn("nx", F.lead("e").over(here)).withColumn("pv", F.lag("e").over(here))

    def lit(e) -> Column:
        return F.struct(F.lit(e["k1"]).alias("k1"), F.lit(e["k2"]).alias("k2"), F.lit(e["n"]).cast("long").alias("n"))

    if edges:
        after, before = [], []
        for i, r in enumerate(edges):
            after += [F.lit(r["part"]), lit(edges[(i + 1) % len(edges)]["a"])]
            before += [F.lit(r["part"]), lit(edges[i - 1]["b"])]
        out = out.withColumn("nx", F.coalesce("nx", F.create_map(*after)[F.col("part")])).withColumn("pv", F.coalesce("pv", F.create_map(*before)[F.col("part")]))
    return written(
        out.select("k1", "k2", "doc_id", "n", F.col("nx.k1").alias("next1"), F.col("nx.k2").alias("next2"), F.col("pv.k1").alias("prev1"), F.col("pv.k2").alias("prev2"), F.col("pv.n").alias("prev_n")),
        "order",
    )


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (longs): one row a document.

    Texts are shuffled once by document, halves of them once more to the document
    before; both fingerprints are counted where those meet.
    """
    body = as_text(text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    order = in_order(keyed.select("doc_id", "k1", "k2", F.length("text").cast("long").alias("n")))
    key = ["k1", "k2"]
    # every use below reads the same three columns, so their one exchange is shared
    whole = keyed.select("k1", "k2", "text").join(order.hint("merge"), key)
    # the first half-length of this text goes to the document before
    gift = whole.select(F.col("prev1").alias("k1"), F.col("prev2").alias("k2"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("lead")).dropDuplicates(key)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int")), "lead")
    met = whole.join(gift.hint("merge"), key).withColumn("edited", edited)
    one = met.select("k1", "k2", "text", "edited")
    tagged = F.transform(F.array("text", "edited"), lambda t, i: F.struct(i.alias("which"), words_of(t).alias("w")))
    each = one.dropDuplicates(key).select("k1", "k2", F.inline(tagged))
    both = votes(each, ["k1", "k2", "which"], F.col("w"))
    pair = both.groupBy(*key).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    facts = met.select("k1", "k2", "doc_id", F.col("n").alias("n_chars"), "next1", "next2", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    rows = written(facts.join(pair.hint("merge"), key), "prints")
    nexts = rows.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("fp").alias("next_fp")).distinct()
    return rows.join(nexts, ["next1", "next2"]).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def block_masks() -> list[int]:
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(queries: DataFrame, everything: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp) and (fp, n) of distinct fingerprints -> fp, other, n, distance: all other fingerprints within ``radius`` bits.

    Needs radius <= 3, for which the six blocks are made.
    """
    if radius > len(BLOCKS) - 3:
        raise ValueError("the block tables hold pairs of at most 3 differing bits")
    masks = block_masks()
    tables, skips = [], []
    for chosen in combinations(range(len(BLOCKS)), 3):
        tables.append(_signed(sum(masks[b] for b in chosen)))
        # an earlier table holds the pair if one of these blocks agrees too
        own = [_signed(masks[b]) for b in range(chosen[-1]) if b not in chosen]
        skips.append(own + [-1] * (3 - len(own)))
    entry = [F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m"), *(F.lit(x).cast("long").alias(f"x{j}") for j, x in enumerate(skips[i]))) for i, m in enumerate(tables)]
    asked = queries.select("fp", F.explode(F.array(*entry)).alias("e")).select("fp", F.col("e.t").alias("t"), F.col("fp").bitwiseAND(F.col("e.m")).alias("key"), "e.x0", "e.x1", "e.x2")
    kept = everything.select(F.col("fp").alias("other"), "n", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(tables)))).alias("e"))
    kept = kept.select("other", "n", F.col("e.t").alias("t"), F.col("other").bitwiseAND(F.col("e.m")).alias("key"))
    x = F.col("fp").bitwiseXOR(F.col("other"))
    first = (asked["t"] == kept["t"]) & (asked["key"] == kept["key"]) & (x != 0) & (F.bit_count(x) <= radius)
    for j in range(3):
        first &= x.bitwiseAND(F.col(f"x{j}")) != 0
    return asked.join(kept, first).select("fp", "other", "n", F.bit_count(x).alias("distance"))


def with_near(rows: DataFrame, asked: Column, *, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with n_near: for rows where ``asked``, how many other documents lie within ``radius`` bits; else null."""
    rows = written(rows, "rows")
    counts = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "counts")
    queries = rows.where(asked).select("fp").distinct()
    more = near(queries, counts, radius).groupBy("fp").agg(F.sum("n").alias("more"))
    mine = queries.join(counts, "fp").join(more, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))
    out = written(mine, "near")
    return rows.join(out, "fp", "left").withColumn("n_near", F.when(asked, F.col("n_near")))
