"""Language-model scoring by cross-entropy difference.

Two bigram models, of the target documents and of all documents (the background),
share one vocabulary and one smoothing, and are matched in size: background counts
weigh as many tokens in all as the target has. A document's score is the mean over its
tokens of the difference of their losses, target minus background: low scores are like
the target.

Both are probability models. The events after a history are the ``V`` distinct words of
all documents and the end of the document; with the weighted counts ``c`` and ``N`` events,

    P(w) = (c(w) + 1) / (N + V + 1),  P(w | u) = (c(u, w) + MU P(w)) / (c(u) + MU)

sum to 1 over the events, as every occurrence of ``u`` is followed by a word or the end.
The first word of a document is scored by ``P(w)``; the end is not scored.

Every word and every pair of neighbours of every document is counted, known by a 64-bit
hash: no cap, no sample, and the tables grow with the corpus. Documents are coded in
blocks of about ``BLOCK`` bytes of text, a row each. A block asks for the sums of its
distinct words and pairs once, sorted by key and cut at the borders of key ranges, as byte
planes of the key steps and its own counts; a task adds up one range and answers each
block in the order asked. A hot word or pair is thus one entry a block, however many
documents have it, and a range is as large as its share of the keys.

Defined cases: null and empty texts have no tokens and score 0; without target
documents both models are uniform and all differences are 0; repeated rows count and
score once each; null ids are no target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvidex.llm.ngram_join import mix
from corvidex.plans.shared import arrow_batches, as_text, join_small, written

#: Bytes of text coded together; bounds the memory of a task, not what is counted.
BLOCK = 8 << 20
#: Bytes of text for each range of keys, and the least number of ranges.
RANGE, LEAST_RANGES = 8 << 20, 16
MU = 50.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1 = np.uint64(0x9E3779B97F4A7C15)

def planes(x: np.ndarray) -> bytes:
    """The values byte by byte of the same weight: what is 0 throughout compresses to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeezed(n: int, *parts: np.ndarray) -> bytes:
    """Arrays of ``n`` values as compressed planes behind their number: small in the JVM's rows and buffers too."""
    return n.to_bytes(8, "little") + pa.compress(b"".join(map(planes, parts)), codec="zstd", asbytes=True)


def unsqueezed(b: bytes, *dtypes: type) -> list[np.ndarray]:
    n = int.from_bytes(b[:8], "little")
    ends = np.cumsum([0, *(n * np.dtype(t).itemsize for t in dtypes)]).tolist()
    body = pa.decompress(b[8:], decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [from_planes(body[i:j], t) for i, j, t in zip(ends, ends[1:], dtypes, strict=False)]


def word_keys(h: np.ndarray) -> np.ndarray:
    """Odd keys of words by their hashes."""
    return mix(h) | np.uint64(1)


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Even keys of neighbours by their hashes."""
    return mix(mix(u * _M1 + np.uint64(1)) + w) & ~np.uint64(1)


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The key range of each key; ascending keys have ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def inner_of(sizes: np.ndarray) -> np.ndarray:
    """Which tokens of documents in a row have a history."""
    inner = np.ones(int(sizes.sum()), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    return inner


def keyed(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of coded documents in a row: inner, the sorted distinct keys, the place there of each word, the place of each inner token's pair."""
    inner = inner_of(sizes)
    h = hashes[ids]
    pairs, where = np.unique(pair_keys(h[:-1][inner[1:]], h[1:][inner[1:]]), return_inverse=True)
    words = word_keys(hashes)
    keys = np.concatenate([words, pairs])
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return inner, keys[order], place[: len(words)], place[len(words) :][where]


def coded(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Written table of blocks of ``docs`` (id, text, target).

    block; ids, sizes and wanted: of its documents the ids, numbers of words and whether they are targets; body:
    their words as numbers; hashes: of its words by number; b, t: its events in all documents and in target ones.
    """
    kind = docs.schema["id"].dataType
    names = [("block", T.LongType()), ("ids", T.ArrayType(kind)), ("sizes", T.BinaryType()), ("wanted", T.BinaryType()), ("body", T.BinaryType()), ("hashes", T.BinaryType()), ("b", T.LongType()), ("t", T.LongType())]
    schema = T.StructType([T.StructField(*x) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        wanted: list[bool] = []
        ids: list[pa.Array] = []
        held = 0

        def closed() -> pa.RecordBatch:
            own, sizes, target = pa.concat_arrays(ids), np.array([len(x) for x in parts], np.int32), np.array(wanted)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            events = sizes + (sizes > 0)
            body = squeezed(int(sizes.sum()), np.concatenate(parts))
            columns = [pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            columns += [pa.array([x], pa.binary()) for x in (sizes.tobytes(), target.tobytes(), body, hashes.tobytes())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([int(events.sum())]), pa.array([int(events[target].sum())])], schema.names)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            parts += [np.array([known.setdefault(w, len(known)) for w in t.translate(_LOWER).split()], dtype=np.int32) for t in texts]
            wanted += [bool(x) for x in batch.column(2).to_pylist()]
            ids.append(batch.column(0))
            held += sum(map(len, texts))
            if held >= block:
                yield closed()
                known, parts, wanted, ids, held, at = {}, [], [], [], 0, at + 1
        if parts:
            yield closed()

    arrow_batches(docs.sparkSession)
    return written(docs.select("id", as_text("text").alias("text"), "target").mapInArrow(run, schema), "blocks")


def block_of(sizes: bytes, body: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents of a block in a row, sizes, hashes."""
    n = np.frombuffer(sizes, np.int32).astype(np.int64)
    return unsqueezed(body, np.int32)[0], n, np.frombuffer(hashes, np.uint64)


def asked(blocks: DataFrame, ranges: int) -> DataFrame:
    """block, part (the key range), body: key steps, counts in all documents, counts in target ones of the block's keys in that range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, hashes = block_of(row["sizes"], row["body"], row["hashes"])
                inner, keys, word, pair = keyed(ids, sizes, hashes)
                target = np.repeat(np.frombuffer(row["wanted"], bool), sizes)
                counts = [np.bincount(word[ids], minlength=len(keys)) + np.bincount(pair, minlength=len(keys))]
                counts.append(np.bincount(word[ids[target]], minlength=len(keys)) + np.bincount(pair[target[inner]], minlength=len(keys)))
                edges = np.searchsorted(ranges_of(keys, ranges), np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(edges))
                for lo in range(0, len(full), 1024):
                    some = full[lo : lo + 1024]
                    bodies = [squeezed(int(j - i), np.diff(keys[i:j], prepend=np.uint64(0)), *(c[i:j].astype(np.uint32) for c in counts)) for i, j in zip(edges[some], edges[some + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"])), pa.array(some, pa.int32()), pa.array(bodies, pa.binary())], ["block", "part", "body"])

    return blocks.select("block", "sizes", "wanted", "body", "hashes").mapInArrow(run, "block long, part int, body binary")


def answered(requests: DataFrame) -> DataFrame:
    """Written table of block, part, body (sums in all documents and in target ones, in the order asked) and, in rows without a block, words: the distinct words of the range."""

    def run(table: pa.Table) -> pa.Table:
        asked = [unsqueezed(x.as_py(), np.uint64, np.uint32, np.uint32) for x in table["body"]]
        ends = np.cumsum([len(x[0]) for x in asked]).tolist()
        keys, where = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked]), return_inverse=True)
        words, n = int((keys & np.uint64(1)).sum()), len(keys)
        del keys
        sums = [np.bincount(where, weights=np.concatenate([x[k] for x in asked]), minlength=n).astype(np.int64) for k in (1, 2)]
        starts = [0, *ends[:-1]]
        bodies = [squeezed(j - i, sums[0][where[i:j]], sums[1][where[i:j]]) for i, j in zip(starts, ends, strict=True)]
        return pa.table([pa.concat_arrays([table["block"].combine_chunks(), pa.nulls(1, pa.int64())]), pa.array([table["part"][0].as_py()] * (len(asked) + 1), pa.int32()), pa.array([*bodies, None], pa.binary()), pa.array([None] * len(asked) + [words], pa.int64())], names=["block", "part", "body", "words"])

    return written(requests.groupBy("part").applyInArrow(run, "block long, part int, body binary, words long"), "answered")


def unconditional(word: np.ndarray, share: float, events: float, room: int) -> np.ndarray:
    """P(w) by the counts of words; a count weighs ``share``; ``room``: V + 1."""
    return (share * word + 1.0) / (share * events + room)


def conditional(pair: np.ndarray, history: np.ndarray, p: np.ndarray, share: float) -> np.ndarray:
    """P(w | u) by the counts of pairs and of their histories; ``p``: P(w)."""
    return (share * pair + MU * p) / (share * history + MU)


def score(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """id, n_tokens, target_loss, background_loss, difference of every document of :func:`coded`."""
    events = blocks.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n_b, n_t = events["b"], events["t"]
    room = answers.where("block is null").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"] + 1
    models = ((n_b, n_t / n_b if n_b else 0.0), (n_t, 1.0))
    fields = [("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("difference", T.DoubleType())]

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, sizes, hashes = block_of(*(rows[c][0].as_py() for c in ("sizes", "body", "hashes")))
        loss = np.zeros((2, len(sizes)))
        if len(ids):
            inner, _, word, pair = keyed(ids, sizes, hashes)
            order = np.argsort(known["part"].to_numpy())
            answers = [unsqueezed(known["body"][int(i)].as_py(), np.int64, np.int64) for i in order]
            of = np.repeat(np.arange(len(sizes)), sizes)
            before = np.flatnonzero(inner) - 1
            for k, (total, share) in enumerate(models):
                sums = np.concatenate([x[k] for x in answers])
                c = sums[word[ids]]
                p = unconditional(c, share, total, room)
                p[inner] = conditional(sums[pair], c[before], p[inner], share)
                loss[k] = np.bincount(of, -np.log(p), len(sizes)) / np.maximum(sizes, 1)
        return pa.table([pa.concat_arrays(rows["ids"].chunks).flatten(), pa.array(sizes), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])], names=["id", *(f[0] for f in fields)])

    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), *(T.StructField(*f) for f in fields)])
    docs = blocks.select("block", "ids", "sizes", "body", "hashes")
    return docs.groupBy("block").cogroup(answers.where("block is not null").select("block", "part", "body").groupBy("block")).applyInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference; ``target_ids``: one column of the ids of target documents."""
    wanted = written(target_ids.select(F.col(target_ids.columns[0]).alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True)), "target")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = coded(join_small(rows, wanted, ["id"], "left"), block=block)
    return score(blocks, answered(asked(blocks, max(LEAST_RANGES, -(-size // RANGE))))).withColumnRenamed("id", "doc_id")
