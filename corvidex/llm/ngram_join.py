"""N-gram Jaccard self-join with PartEnum signatures, and its components.

Sets of word shingles fall into size bands; inside a band, Jaccard similarity s
bounds the symmetric difference by k. The feature domain is partitioned by hash
into n1 cells of 3 sub-cells each; n1 is chosen so that at least one cell of two
linked sets differs in at most one place. For every cell the 3 ways of leaving one
sub-cell out are enumerated, and the content of the two others is a signature, so
linked sets share one. A set near the upper end of its band signs in the next band
too. A quarter more cells than that makes them share many, so each set may leave out
its signatures of least content before any shuffle, and its most popular ones after
it: both are what unrelated sets share by a common passage.

Signatures without content say nothing and would be shared by many; they are left
out wherever a set has cells to spare (then the argument holds on its other cells)
and kept where it has not, so no pair is lost.

Equal sets are one node, found by an aggregate, however many copies there are.
Shared signatures are resolved in two ways: first every member is compared with
the most central set of its signature (a star, linear in members), then only
members of still different components are paired, after lossless filters by size
and by a parity sketch (bits flipped by each differing element). Pairs are
verified on the whole shingle sets.

Shingles and sets are known by 64-bit hashes.

Defined cases: null texts and texts without words have an empty set, link with
nothing and are their own component; texts of fewer words than a shingle are one
shingle; repeated rows give a row each; a null id is never the smallest of its
component but gets its component; only the named columns are read, and no column name
of the input clashes with one of ours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.llm.names import quoted, unused
from corvidex.operators.graph import connected_components
from corvidex.plans.shared import arrow_batches, as_text, checked, dropped, join_small, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SKETCH = 8
#: The low bits of a signature name its band.
BAND_BITS = 63


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; link when 100 * intersection >= ``percent`` * union."""

    words: int = 3
    percent: int = 90
    widen: float = 1.5

    @cached_property
    def bands(self) -> list[tuple[int, int]]:
        """(largest size, k) of each band, up to sets of 2**40."""
        out, r, g = [], 1, self.percent
        widen = max(self.widen, 100 / g + 0.01)
        while r < 1 << 40:
            out.append((r, (2 * r * (100 - g)) // (100 + g)))
            r = max(r + 1, int(r * widen))
        return out

    def cells(self, band: int) -> tuple[int, int]:
        """(need, n1): cells that must have content, and cells.

        ``2 * (need - extra) >= k + 1``, so among any ``need`` cells of two linked sets one
        has at most one difference, and at least ``2 * extra + 1`` signatures are shared.
        """
        least = (self.bands[band][1] + 2) // 2
        extra = self.extra(band)
        return least + extra, least + extra + (max(1, least // 12) if least > 4 else 0)

    def extra(self, band: int) -> int:
        """Of the 2 * extra + 1 signatures shared, as many may go by content and as many again by popularity."""
        return ((self.bands[band][1] + 2) // 2) // 4

    def bands_of(self, size: int) -> list[int]:
        tops = [r for r, _ in self.bands]
        b = int(np.searchsorted(tops, size))
        return [b, b + 1] if size * 100 // self.percent > tops[b] else [b]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(h))
    acc = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        acc = mix(acc * _M1 + h[k : len(h) - width + 1 + k])
    return np.unique(acc)


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else 0


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parity bits: each element flips one, so sketches differ in no more bits than sets in elements."""
    bits = np.bincount((mix(s * _M3) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(s: np.ndarray, join: Join) -> np.ndarray:
    """Signatures of a set in its band or bands."""
    out = []
    for b in join.bands_of(len(s)) if len(s) else ():
        k = join.bands[b][1]
        if k == 0:
            continue  # only equal sets link here
        need, n1 = join.cells(b)
        cell = mix(s + np.uint64((b + 1) * int(_M3) & (2**64 - 1)))
        at = ((cell >> np.uint64(33)) % np.uint64(n1)).astype(np.int64) * 3 + ((cell & np.uint64(0xFFFFFFFF)) % np.uint64(3)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(3 * n1 + 1))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s * _M1 + np.uint64(7))[order], dtype=np.uint64)])
        content = (run[edges[1:]] - run[edges[:-1]]).reshape(n1, 3)
        count = np.diff(edges).reshape(n1, 3)
        left = np.stack([content[:, [1, 2]], content[:, [0, 2]], content[:, [0, 1]]], axis=1)
        size = np.stack([count[:, 1] + count[:, 2], count[:, 0] + count[:, 2], count[:, 0] + count[:, 1]], axis=1)
        where = (np.arange(3 * n1, dtype=np.uint64) + np.uint64(b) * np.uint64(1 << 40)).reshape(n1, 3)
        sig = mix(mix(where * _M1 + left[:, :, 0]) * _M3 + left[:, :, 1])
        full = size > 0
        if full.all(axis=1).sum() < need:
            full[:] = True
        sig, size = sig[full], size[full]
        # those of least content go: one order of all signatures, as equal ones have equal content
        few = join.extra(b)
        sig = sig[np.lexsort((sig, size))[few:]] if few else sig
        out.append((sig & ~np.uint64(BAND_BITS)) | np.uint64(b & BAND_BITS))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, digest, sk0..sk3."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d, sk = [], [], []
            for t in _texts(batch, 1):
                s = shingles(t, join.words)
                n.append(len(s))
                d.append(digest(s))
                sk.append(sketch(s))
            columns = np.array(sk, dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), *(pa.array(np.ascontiguousarray(columns[:, j])) for j in range(SKETCH))], ["doc_id", "n_shingles", "digest", *(f"sk{j}" for j in range(SKETCH))]
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, n_shingles long, digest long, " + ", ".join(f"sk{j} long" for j in range(SKETCH)))


def signed(docs: DataFrame, join: Join) -> DataFrame:
    """(text) -> sig, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task signs each set once, as far as it remembers
        for batch in batches:
            sig, own = [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for t in _texts(batch, 0):
                s = shingles(t, join.words)
                d = digest(s)
                if d in seen:
                    continue
                seen.add(d)
                x = signatures(s, join)
                sig.append(x)
                own.append(np.full(len(x), d, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(own))], ["sig", "digest"])

    return docs.select("text").mapInArrow(run, "sig long, digest long")


def shingle_arrays(docs: DataFrame, join: Join) -> DataFrame:
    """(text) -> digest, s: the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, join.words).view(np.int64) for t in _texts(batch, 0)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            own = pa.array([digest(x.view(np.uint64)) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(offsets), values)], ["digest", "s"])

    return docs.select("text").mapInArrow(run, "digest long, s array<long>")


def _linked(common: Column, a: Column, b: Column, join: Join) -> Column:
    return 100 * common >= join.percent * (a + b - common)


def _possible(a: str, b: str, join: Join) -> Column:
    """Size and parity filters; neither drops a linked pair."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    flips = F.bit_count(F.col(f"{a}.sk0").bitwiseXOR(F.col(f"{b}.sk0")))
    for j in range(1, SKETCH):
        flips = flips + F.bit_count(F.col(f"{a}.sk{j}").bitwiseXOR(F.col(f"{b}.sk{j}")))
    sizes = (100 * na >= join.percent * nb) & (100 * nb >= join.percent * na)
    return sizes & ((100 + join.percent) * flips <= (100 - join.percent) * (na + nb))


def candidates(docs: DataFrame, join: Join) -> DataFrame:
    """(sig, digest, shares) of signatures that different sets share, each set without its most popular ones.

    Linked sets share extra + 1 of the signatures that :func:`signatures` gives. Leaving
    out of each set the extra ones that come last in one order of all signatures (here by
    popularity) leaves one shared, and it is not one that many unrelated sets have by a
    common passage.
    """
    mates = Window.partitionBy("sig")
    shared = signed(docs, join).withColumn("lo", F.min("digest").over(mates)).withColumn("hi", F.max("digest").over(mates)).where("lo <> hi")
    # still together by signature: neither step below moves a row
    shared = written(shared.select("sig", "digest").distinct().withColumn("sets", F.count(F.lit(1)).over(mates)).select("sig", "digest", "sets"), "shared")
    band = F.col("sig").bitwiseAND(F.lit(BAND_BITS))
    spare = F.element_at(F.array(*(F.lit(join.extra(b)) for b in range(len(join.bands)))), (band + 1).cast("int"))
    last_first = Window.partitionBy("digest", "band").orderBy(F.desc("sets"), F.desc("sig"))
    ranked = shared.withColumn("band", band).withColumn("shares", F.count(F.lit(1)).over(Window.partitionBy("digest"))).withColumn("place", F.row_number().over(last_first))
    left = written(ranked.where(F.col("place") > spare).select("sig", "digest", "shares"), "left")
    dropped(shared)
    return left


def links(docs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame | None:
    """(doc_id, text) and (digest, n, rep, sk..) -> (a, b) edges between digests whose components are those of all links."""
    left = candidates(docs, join)
    involved = written(left.select("digest").distinct().join(nodes, "digest").select("digest", "n", "rep", *(f"sk{j}" for j in range(SKETCH))), "involved")
    if involved.isEmpty():
        return None
    facts = involved.select("digest", F.struct("n", *(f"sk{j}" for j in range(SKETCH))).alias("f"))
    fa, fb = facts.withColumnsRenamed({"digest": "a", "f": "fa"}), facts.withColumnsRenamed({"digest": "b", "f": "fb"})

    def sets_for(pairs: DataFrame) -> DataFrame:
        """(digest, s) of the sets in the pairs, from the texts of one document each; sets carry their own digest, so rows that repeat an id can't be taken for each other."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        reps = written(wanted.join(involved, "digest").select("rep").distinct(), "reps")
        picked = docs.join(checked(reps), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        return written(shingle_arrays(picked, join), "sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("digest").alias("b"), F.col("s").alias("sb")), "b")
        two = one.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        # no distinct here: it would keep the rows of a hub together, which a skewed join may split
        return two.where(_linked(common, F.size("sa"), F.size("sb"), join)).select("a", "b")

    # stars: every member with the most central set of its signature, the hub it shares most with
    hub = left.groupBy("sig").agg(F.max(F.struct("shares", "digest")).alias("hub"))
    star = left.join(hub, "sig").where(F.col("hub.digest") != F.col("digest")).groupBy(F.col("hub.digest").alias("a"), F.col("digest").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    star = star.join(fa, "a").join(fb, "b").where(_possible("fa", "fb", join))
    star = written(star.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b"), "star")
    sets = sets_for(star)
    edges = written(verified(star, sets), "edges")
    dropped(sets)
    # the rest: pairs of signature mates in different components
    comps = written(connected_components(edges), "comps")
    named = left.join(comps.withColumnRenamed("node", "digest"), "digest", "left").select("sig", "digest", F.coalesce("component", "digest").alias("c"))
    mates = Window.partitionBy("sig")
    apart = written(named.withColumn("c0", F.min("c").over(mates)).withColumn("c1", F.max("c").over(mates)).where("c0 <> c1").join(facts, "digest").select("sig", "digest", "f", "c"), "apart")
    if not apart.isEmpty():
        one = apart.select("sig", F.col("digest").alias("a"), F.col("f").alias("fa"), F.col("c").alias("ca"))
        two = apart.select(F.col("sig").alias("sig2"), F.col("digest").alias("b"), F.col("f").alias("fb"), F.col("c").alias("cb"))
        rest = written(one.join(two, (F.col("sig") == F.col("sig2")) & (F.col("ca") < F.col("cb")) & _possible("fa", "fb", join)).select("a", "b").distinct(), "rest")
        if not rest.isEmpty():
            sets = sets_for(rest)
            edges = written(edges.unionByName(verified(rest, sets)), "edges")
            dropped(sets)
    dropped(left, involved, star, apart, comps)
    return edges


def placed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, digest, c, component_id: one row a document; c names the component by a digest (null without shingles)."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), as_text(F.col(quoted(text))).alias("text"))
    sets = written(sets_of(rows, join), "sets")
    nodes = written(
        sets.where("n_shingles > 0").groupBy("digest").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("rep"), *(F.max(f"sk{j}").alias(f"sk{j}") for j in range(SKETCH))), "nodes"
    )
    edges = links(rows, nodes, join)
    if edges is None:
        place = nodes.select("digest", F.col("digest").alias("c"), F.col("rep").alias("component_id"))
    else:
        comp = connected_components(edges)
        named = nodes.join(comp.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("c"))
        # a written table of a row a component joins without gathering the component's rows
        named = written(named, "named")
        least = written(named.groupBy("c").agg(F.min("rep").alias("component_id")), "least")
        place = join_small(named, least, ["c"], "inner").select("digest", "c", "component_id")
    place = written(place, "place")
    cols = ["doc_id", "n_shingles", "digest", "c", "component_id"]
    some = sets.where("n_shingles > 0").select(*cols[:3]).join(place, "digest").select(*cols)
    none = F.lit(None).cast(sets.schema["digest"].dataType)
    return some.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", none.alias("digest"), none.alias("c"), F.col("doc_id").alias("component_id")))


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document; component_id is the smallest id reachable by links."""
    return placed(docs, doc_id=doc_id, text=text, join=join).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join(5, 80)) -> DataFrame:
    """``docs`` with exactly one row of each component, one with the smallest id (null after all others); repeated rows go too.

    Rows without shingles are in no component: they stay, but for rows that repeat an id and its text.
    """
    found = placed(docs, doc_id=doc_id, text=text, join=join)
    own = F.col(quoted(doc_id))
    lost, twice = unused(docs, "lost", "twice")
    # an id of one row tells which row to drop; rows with a repeated or null id are told apart by their set
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(lost)).distinct(), "gone")
    again = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(twice)), "again")
    kept = docs.where(own.isNotNull()).join(checked(gone), own == F.col(lost), "left_anti")
    repeated, nameless = not again.isEmpty(), not found.where("doc_id is null").isEmpty()
    unclear = docs.where(own.isNull())
    if repeated:
        kept = kept.join(again, own == F.col(twice), "left_anti")
        unclear = unclear.unionByName(docs.join(again, own == F.col(twice), "left_semi"))
    if repeated or nameless:
        kept = kept.unionByName(_kept_rows(unclear, found, doc_id, text, join))
    return kept


def _kept_rows(rows: DataFrame, found: DataFrame, doc_id: str, text: str, join: Join) -> DataFrame:
    """Of ``rows``, which repeat ids or have none, one for each component that is theirs by :func:`placed`, and those without shingles."""
    keeper, kept_set, body, size, mark = unused(rows, "keeper", "set", "text", "n", "digest")
    least = found.where("c is not null").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("k"))
    keepers = written(least.select(F.col("k.doc_id").alias(keeper), F.col("k.digest").alias(kept_set)), "keepers")
    own, text_ = F.col(quoted(doc_id)), as_text(F.col(quoted(text)))
    texts = rows.select(text_.alias("text")).distinct()
    sets = written(sets_of(texts.select(F.col("text").alias("doc_id"), "text"), join).select(F.col("doc_id").alias(body), F.col("n_shingles").alias(size), F.col("digest").alias(mark)), "texts")
    told = rows.join(sets, text_ == F.col(body))
    one = told.where(F.col(size) > 0).join(keepers, (F.col(mark) == F.col(kept_set)) & own.eqNullSafe(F.col(keeper)), "left_semi").dropDuplicates([doc_id, mark])
    bare = told.where(F.col(size) == 0)
    bare = bare.where(own.isNull()).unionByName(bare.where(own.isNotNull()).dropDuplicates([doc_id, body]))
    return one.unionByName(bare).select(*(F.col(quoted(c)) for c in rows.columns))
