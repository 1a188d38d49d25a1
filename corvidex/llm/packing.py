"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are at most the sequence size (2048), so the whole packing problem is a
histogram of 2048 counts whatever the corpus size. The driver plans on that
histogram: longest lengths first, each gap is filled exactly by one, two or three
lengths from an index of their sums, as often as availability counts allow; what no
combination fills goes best-fit. The plan is a list of (pattern, multiplicity),
each step using up at least one length, so it has a bounded number of patterns.

Pieces are dealt to the pattern slots by their rank within a length. Ranks come
from running counts inside each tokenising task plus prefix sums over tasks, so no
length, however common, is sorted or gathered in one place.

Defined cases: a null text is empty and gives one piece, the closing id; repeated
rows are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvidex.plans.shared import arrow_batches, join_small, written

CAPACITY = 2048
CLOSING_ID = 0


class WordEncoder:
    """Ids of a tokenizer whose pre-tokens never span blanks, remembered by blank-separated chunk.

    The memory is cleared when full, so a worker's size is bounded.
    """

    ODD = re.compile("[\x1c-\x1f]")  # str.split() parts here, the tokenizer doesn't
    TAIL = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?|&%$#*]*)")
    LETTERS = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str, room: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tok, self.room = Tokenizer.from_file(path), room
        self.model = self.tok.model
        # byte-level pre-tokenising: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def core(self, word: str) -> bytes:
        got = self.cores.get(word)
        if got is None:
            if self.LETTERS.fullmatch(word):  # one pre-token: straight to the merges
                ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes))]
                got = np.array(ids, dtype="<u4").tobytes()
            else:
                got = self.whole(word)
            self.cores[word] = got
        return got

    def learn(self, chunks: set[str]) -> None:
        if len(self.words) + len(self.cores) + len(chunks) > self.room:
            self.words.clear()
            self.cores.clear()
        for c in chunks:
            if c not in self.words:
                m = self.TAIL.fullmatch(c)  # letters and marks are different pre-tokens
                self.words[c] = self.whole(c) if m is None else self.core(m[1].lower()) + self.core(m[2]) if m[2] else self.core(m[1].lower())

    def __call__(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.whole(text)
        chunks = text.split()
        try:
            return b"".join(map(self.words.__getitem__, chunks))
        except KeyError:
            self.learn(set(chunks))
            if len(self.words) < self.room:
                return b"".join(map(self.words.__getitem__, chunks))
            out = b"".join(map(self.words.__getitem__, chunks))
            self.words.clear()
            return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(docs: DataFrame, *, doc_id: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, local (rank of the piece among equal lengths of its task)."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, local = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = (encode(t) if t else b"") + closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at : at + 4 * capacity]
                    n = len(body) >> 2
                    row.append(i)
                    piece.append(k)
                    start.append(at >> 2)
                    length.append(n)
                    crc.append(zlib.crc32(body))
                    local.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([part] * len(row), pa.int32()),
                    pa.array(local, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local long"
    )


class SumIndex:
    """Sum -> one, two or three lengths that have it, the largest first, as far as availability counts allow.

    For every sum the index holds the larger length of its first pair and the largest of its
    first triple, filled for all sums when it is made. Counts only fall, so an entry that is
    used up moves on to the next smaller length and never comes back: over a whole plan each
    entry passes its lengths once.
    """

    def __init__(self, have: np.ndarray):
        self.have = have
        n = len(have)
        self.two, self.three = np.zeros(n, np.int64), np.zeros(n, np.int64)  # 0: no such sum (any more)
        for s in range(2, n):
            self.two[s] = self._pair(s, s - 1)
        for s in range(3, n):
            self.three[s] = self._triple(s, s - 2)

    def fits(self, lengths: list[int]) -> bool:
        return all(self.have[x] >= lengths.count(x) for x in set(lengths))

    def _pair(self, s: int, top: int, lead: list[int] | None = None) -> int:
        """The largest length up to ``top`` that makes ``s`` with one not longer."""
        a = np.arange(top, (s + 1) // 2 - 1, -1)
        good = a[(self.have[a] > 0) & (self.have[s - a] > 0)]
        return next((x for x in good.tolist() if self.fits([*(lead or ()), x, s - x])), 0)

    def _triple(self, s: int, top: int, lead: list[int] | None = None) -> int:
        """The largest length up to ``top`` that makes ``s`` with a pair of lengths not longer."""
        a = np.arange(top, (s + 2) // 3 - 1, -1)
        for x in a[(self.have[a] > 0) & (self.two[s - a] > 0)].tolist():
            if self.pair(s - x, [*(lead or ()), x], most=x):
                return x
        return 0

    def pair(self, s: int, lead: list[int], most: int | None = None) -> list[int] | None:
        if s < 2 or not self.two[s]:
            return None
        top = int(self.two[s])
        if not self.fits([top, s - top]):
            top = self.two[s] = self._pair(s, top - 1)
        if top and (most is not None and top > most or not self.fits([*lead, top, s - top])):
            top = self._pair(s, min(top, most or top), lead)
        return [top, s - top] if top else None

    def triple(self, s: int, lead: list[int]) -> list[int] | None:
        if s < 3 or not self.three[s]:
            return None
        top = int(self.three[s])
        rest = self.pair(s - top, [top], most=top) if self.have[top] else None
        if rest is None:
            top = self.three[s] = self._triple(s, top - 1)
            rest = self.pair(s - top, [top], most=top) if top else None
        if rest is not None and not self.fits([*lead, top, *rest]):
            top = self._triple(s, top, lead)
            rest = self.pair(s - top, [*lead, top], most=top) if top else None
        return [top, *rest] if rest is not None else None

    def complement(self, first: int, capacity: int) -> list[int] | None:
        """``first`` and what fills its gap exactly."""
        gap = capacity - first
        if gap == 0:
            return [first]
        if self.fits([first, gap]):
            return [first, gap]
        rest = self.pair(gap, [first]) or self.triple(gap, [first])
        return [first, *rest] if rest else None


def plan_patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, times), ...], multiplicity)] using every count of ``histogram`` (index: length) exactly.

    Gaps filled exactly first, by the index of single, pair and triple sums; the rest best-fit.
    """
    have = histogram.astype(np.int64).copy()
    index = SumIndex(have)
    plans: list[tuple[list[tuple[int, int]], int]] = []

    def use(lengths: list[int]) -> None:
        kinds = sorted({x: lengths.count(x) for x in lengths}.items(), reverse=True)
        times = min(int(have[x]) // t for x, t in kinds)
        for x, t in kinds:
            have[x] -= t * times
        plans.append((kinds, times))

    for first in range(capacity, 0, -1):
        while have[first] > 0:
            got = index.complement(first, capacity)
            if got is None:
                break
            use(got)
    for first in range(capacity, 0, -1):  # best fit: the longest that still goes in
        while have[first] > 0:
            lengths, gap = [first], capacity - first
            while gap:
                usable = np.flatnonzero(have[1 : gap + 1])
                pick = next((int(x) + 1 for x in usable[::-1] if have[x + 1] > lengths.count(int(x) + 1)), 0)
                if not pick:
                    break
                t = min(gap // pick, int(have[pick]) - lengths.count(pick))
                lengths += [pick] * t
                gap -= pick * t
            use(lengths)
    return plans


def slots_of(plans: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, multiplicity, first sequence id, offset), by length and first rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for kinds, times in plans:
        offset = 0
        for length, t in kinds:
            at = used.get(length, 0)
            rows.append((length, at, times, base, offset))
            used[length] = at + times * t
            offset += length * t
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    arrow_batches(spark)
    pieces = written(pieces_of(docs, doc_id=doc_id, text=text, path=path or tokenizer_path(), capacity=capacity), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(slots_of(plan_patterns(histogram, capacity)))

    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r, s = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False), slots.value
        at = np.searchsorted(s[:, 0] * (1 << 44) + s[:, 1], n * (1 << 44) + r, side="right") - 1
        nth = r - s[at, 1]
        return pa.StructArray.from_arrays([pa.array(s[at, 3] + nth % s[at, 2]), pa.array(s[at, 4] + n * (nth // s[at, 2]))], ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = written(counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shift")
    ranked = join_small(pieces, shift, ["part", "length"], "inner")
    return ranked.withColumn("at", place("length", F.col("local") + F.col("shift"))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
