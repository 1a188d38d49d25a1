"""Edit-aware token counts.

A document's pre-tokens lie in blocks under a segment tree whose nodes sum
characters and tokens. An edit walks down by character sums, re-splits from the
last pre-token that the edit or its one-character context can reach until the new
boundaries meet the old ones, encodes only those pre-tokens and updates the sums
above the blocks it touched. Splitting looks ahead but never back, so from a common
boundary on nothing changes.

Trees are kept in a table: the text and, pre-token by pre-token, its characters and its
tokens (:func:`trees`). :func:`apply_edits` restores each tree from those, without splitting
or encoding the text again, applies the row's edits and gives the table's new rows, from
which later edits go on. A block that grows beyond four times its size is split.

A worker's memory: the pre-tokens of a long text are counted slice by slice, and what
is remembered of earlier ones is bounded by number and by characters.

Defined cases: null and empty texts have no tokens; edits beyond the end are cut to
it; a null list of edits has none; rows are independent, so repeated rows, null ids and
ties don't matter; columns named like a result give way to it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvidex.llm.names import quoted, unused
from corvidex.plans.shared import arrow_batches, as_text, written

BLOCK = 64
# Pre-tokens of a long text that are held as strings at once.
SLICE = 1 << 17
# The pre-token pattern over Latin-1, with its classes spelled out; other texts take the full one.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Counter:
    """Pre-tokens and their token counts; counts are remembered up to ``room`` pre-tokens of 16 characters on average."""

    def __init__(self, path: str, room: int = 400_000):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full, self.room, self.known, self.held = regex.compile(public_tokenizers.PATTERN), room, {}, 0

    def pattern(self, text: str):
        if text.isascii():
            return LATIN
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full
        return LATIN

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        for p in set(pieces).difference(known):
            known[p] = len(self.enc.encode_ordinary(p))
            self.held += len(p)
        out = [known[p] for p in pieces]
        if len(known) > self.room or self.held > 16 * self.room:
            known.clear()
            self.held = 0
        return out

    def slices(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, at most SLICE of them at once."""
        pattern = self.pattern(text)
        if len(text) <= SLICE:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while pieces := [m[0] for m in islice(found, SLICE)]:
            yield pieces

    def split(self, text: str) -> tuple[array, array]:
        """Characters and tokens of every pre-token."""
        lengths, counts = array("i"), array("i")
        for pieces in self.slices(text):
            lengths.extend(map(len, pieces))
            counts.extend(self.counts(pieces))
        return lengths, counts


class Tree:
    """A text, its pre-token blocks and a segment tree of (characters, tokens) over the blocks."""

    def __init__(self, text: str, counter: Counter, lengths: list[int], counts: list[int]):
        self.text, self.counter = text, counter
        self.blocks = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.build()
        self.encoded = 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        lengths, counts = counter.split(text)
        return cls(text, counter, lengths.tolist(), counts.tolist())

    def build(self) -> None:
        """The sums of all nodes from the blocks."""
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), dtype=np.int64)
        self.sums[self.leaves : self.leaves + len(self.blocks)] = [(sum(x), sum(y)) for x, y in self.blocks]
        at = self.leaves
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at //= 2

    def lists(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of every pre-token."""
        return [n for x, _ in self.blocks for n in x], [n for _, y in self.blocks for n in y]

    @property
    def tokens(self) -> int:
        return int(self.sums[1][1])

    def block_at(self, char: int) -> tuple[int, int]:
        """The block holding a character, and the characters before the block."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if char >= before + self.sums[node][0] and self.sums[node + 1][0]:
                before += int(self.sums[node][0])
                node += 1
        return node - self.leaves, before

    def update(self, b: int) -> None:
        node = self.leaves + b
        self.sums[node] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        # both patterns split Latin-1 text alike, so old boundaries hold whichever one is used now
        text = self.text[:start] + new + self.text[end:]
        # the first pre-token ending at start - 1 or later may change: it saw the character after next
        b, at = self.block_at(max(start - 2, 0))
        first, i = b, 0
        while i < len(self.blocks[b][0]) and at + self.blocks[b][0][i] + 1 < start:
            at += self.blocks[b][0][i]
            i += 1
        pattern, shift = self.counter.pattern(text), len(new) - (end - start)
        pos, pieces = at, []
        old, ob, oi = at, b, i  # the next old boundary and the pre-token after it
        while True:
            while old < end or old + shift < pos:
                while ob < len(self.blocks) and oi >= len(self.blocks[ob][0]):
                    ob, oi = ob + 1, 0
                if ob >= len(self.blocks):
                    break
                old += self.blocks[ob][0][oi]
                oi += 1
            if pos == old + shift and old >= end or pos >= len(text):
                break
            m = pattern.match(text, pos)
            pieces.append(m[0])
            pos = m.end()
        counts = self.counter.counts(pieces)
        self.encoded += len(pieces)
        head, tail = tuple(x[:i] for x in self.blocks[first]), ([], [])
        last = min(ob, len(self.blocks) - 1)
        if pos < len(text):
            tail = tuple(x[oi:] for x in self.blocks[last]) if ob < len(self.blocks) else ([], [])
        for k in range(first, last + 1):
            self.blocks[k] = ([], [])
        self.blocks[first] = (head[0] + list(map(len, pieces)), head[1] + counts)
        if last == first:
            self.blocks[first] = (self.blocks[first][0] + tail[0], self.blocks[first][1] + tail[1])
        else:
            self.blocks[last] = tail
        self.text = text
        if len(self.blocks[first][0]) > 4 * BLOCK:
            x, y = self.blocks[first]
            self.blocks[first : first + 1] = [(x[k : k + BLOCK], y[k : k + BLOCK]) for k in range(0, len(x), BLOCK)]
            self.build()
        else:
            for k in range(first, last + 1):
                self.update(k)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def packed(values: list[int] | array) -> bytes:
    """One byte a value where they fit, else four; the first byte tells."""
    x = np.array(values, dtype=np.int32)
    return b"\x01" + x.astype(np.uint8).tobytes() if not len(x) or x.max() < 256 else b"\x04" + x.tobytes()


def unpacked(b: bytes) -> list[int]:
    return np.frombuffer(b, np.uint8 if b[0] == 1 else np.int32, offset=1).tolist()


EDIT = "array<struct<start:int,end:int,new:string>>"
_TREE = T.StructType([T.StructField("lengths", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_pieces", T.LongType())])
_EDITED = T.StructType([T.StructField("text", T.StringType()), *_TREE.fields, T.StructField("n_encoded", T.LongType())])


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def trees(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with its text not null, and lengths, counts (the tree), n_tokens, n_pieces: a table to write."""
    path = _path(path)
    arrow_batches(docs.sparkSession)

    @arrow_udf(_TREE)
    def run(text: pa.Array) -> pa.Array:
        rows = []
        for t in text.to_pylist():
            x, y = counter(path).split(t)
            rows.append((packed(x), packed(y), sum(y), len(x)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], _TREE.names)

    (tree,) = unused(docs, "tree")
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in [n.lower() for n in (text, *_TREE.names)]]
    body = as_text(F.col(quoted(text)))
    return docs.withColumn(text, body).withColumn(tree, run(F.col(quoted(text)))).select(*kept, F.col(quoted(text)), *(F.col(tree)[n].alias(n) for n in _TREE.names))


def apply_edits(rows: DataFrame, edits: Column, *, path: str | None = None, text: str = "text") -> DataFrame:
    """Rows of a table of :func:`trees` after ``edits``, a column of type :data:`EDIT` applied in order, with n_before and n_encoded (pre-tokens encoded for them)."""
    path = _path(path)
    arrow_batches(rows.sparkSession)

    @arrow_udf(_EDITED)
    def run(text: pa.Array, lengths: pa.Array, counts: pa.Array, edits: pa.Array) -> pa.Array:
        out = []
        for t, x, y, todo in zip(text.to_pylist(), lengths.to_pylist(), counts.to_pylist(), edits.to_pylist(), strict=True):
            if todo:
                tree = Tree(t, counter(path), unpacked(x), unpacked(y))
                for e in todo:
                    tree.edit(e["start"], e["end"], e["new"])
                x, y = tree.lists()
                out.append((tree.text, packed(x), packed(y), tree.tokens, len(x), tree.encoded))
            else:
                n = unpacked(y)
                out.append((t, x, y, sum(n), len(n), 0))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, f) for c, f in zip(columns, types, strict=True)], _EDITED.names)

    (done,) = unused(rows, "done")
    ours = [n.lower() for n in (text, *_EDITED.names, "n_before")]
    kept = [F.col(quoted(c)) for c in rows.columns if c.lower() not in ours]
    new = rows.withColumn(done, run(F.col(quoted(text)), F.col("lengths"), F.col("counts"), edits.cast(EDIT)))
    return new.select(*kept, F.col("n_tokens").alias("n_before"), F.col(done)["text"].alias(text), *(F.col(done)[n].alias(n) for n in _EDITED.names[1:]))


def sample_edits(text: Column) -> Column:
    """Three edits of a text, from its end to its start: a replacement by its own head, a deletion, an insertion."""
    n = F.length(text)
    places = ((3 * n / 4, 9, F.left(text, F.lit(24))), (n / 2, 17, F.lit("")), (n / 4, 0, F.lit(" Note 2: it's new,\n")))
    return F.array(*(F.struct(F.floor(at).cast("int").alias("start"), (F.floor(at) + more).cast("int").alias("end"), new.alias("new")) for at, more, new in places))


def edited_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_pieces, n_encoded: trees go to a table, :func:`sample_edits` are applied to what is read from it."""
    kept = written(trees(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), path=path), "trees", codec="zstd")
    done = apply_edits(kept.withColumnRenamed("n_pieces", "pieces_before"), sample_edits(F.col("text")), path=path)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.col("pieces_before").alias("n_pieces"), "n_encoded")
