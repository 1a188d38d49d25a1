"""Full-text search over a postings table, ranked by BM25.

Postings are (doc, col, term, pos). A query is parsed on the driver into terms,
phrases, prefixes, AND, OR and NOT, and becomes aggregates over the postings of its
own terms; over a stored index (clustered by term) only their files and row groups are
read, with the lengths of documents from a table of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.plans.shared import checked

# Letters with marks and what they are searched as.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
K1, B = 1.2, 0.75
# The indexed columns of items and of comments, in order.
ISSUE_COLUMNS = (
    "issue_key issue_int title description summary resolution resolution_description project_key type priority status assignee reporter "
    "work_group change_category change_impact related_url related_artifacts related_pages"
).split()
COMMENT_COLUMNS = "comment_id issue_key author body".split()


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, marks folded."""
    return F.filter(F.split(F.translate(F.lower(text), _MARKED, _PLAIN), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold(word: str) -> str:
    return word.lower().translate(str.maketrans(_MARKED, _PLAIN))


def cells(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    """doc, col, t: the terms of a column of a row, in order."""
    each = F.array(*(F.struct(F.lit(c).alias("col"), terms_of(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("t")) for c in columns))
    return df.select(F.col(doc).alias("doc"), F.inline(each))


def postings(df: DataFrame, doc: str, columns: list[str]) -> DataFrame:
    return cells(df, doc, columns).select("doc", "col", F.posexplode("t").alias("pos", "term"))


def lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc").agg(F.count(F.lit(1)).alias("len"))


def cell_lengths(cell: DataFrame) -> DataFrame:
    """As :func:`lengths` of the postings of :func:`cells`, summed in the task of a document first: its numbers are shuffled, not its postings."""
    return cell.select("doc", F.size("t").cast("long").alias("n")).where("n > 0").groupBy("doc").agg(F.sum("n").alias("len"))


def cell_counts(cell: DataFrame, again: DataFrame) -> DataFrame:
    """doc, col, n, terms (different ones), pos_sum of the postings of :func:`cells`.

    A document's terms are counted where its cell is; only those of the ids in ``again``, written on
    disk, which stand in several rows, meet in a shuffle.
    """
    n = F.size("t").cast("long")
    single = cell.join(checked(again), cell["doc"] == F.col("again"), "left_anti").where(n > 0)
    once = single.select("doc", "col", n.alias("n"), F.size(F.array_distinct("t")).cast("long").alias("terms"), F.expr("size(t) * (size(t) - 1L) div 2").alias("pos_sum"))
    rows = cell.join(checked(again), cell["doc"] == F.col("again"), "left_semi").select("doc", "col", F.posexplode("t").alias("pos", "term"))
    return once.unionByName(rows.groupBy("doc", "col").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"), F.sum("pos").alias("pos_sum")))


def column_counts(parts: list[DataFrame]) -> DataFrame:
    """col, n, terms, docs of the postings of the :func:`cells` in ``parts``: documents and terms are counted apart, each summed in the scan's tasks first."""
    cell = reduce(DataFrame.unionByName, parts).where(F.size("t") > 0)
    docs = cell.groupBy("col", "doc").agg(F.sum(F.size("t")).alias("n")).groupBy("col").agg(F.sum("n").alias("n"), F.count("doc").alias("docs"))
    terms = cell.select("col", F.explode("t").alias("term")).distinct().groupBy("col").agg(F.count(F.lit(1)).alias("terms"))
    return docs.join(terms, "col").select("col", "n", "terms", "docs")


@dataclass(frozen=True)
class Node:
    """op: term, prefix, phrase (words) or and, or, not (parts)."""

    op: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def leaves(self) -> list[Node]:
        return [self] if self.words else [x for p in self.parts for x in p.leaves()]


class QueryError(ValueError):
    pass


def parse(query: str) -> Node:
    """``a b`` and ``a AND b``: both; ``a OR b``; ``a NOT b``; ``"a b"``: a phrase; ``a*``: a prefix; parentheses. NOT binds tightest, then AND, then OR."""
    items = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def peek() -> str | None:
        return items[at] if at < len(items) else None

    def take() -> str:
        nonlocal at
        at += 1
        return items[at - 1]

    def atom() -> Node:
        x = peek()
        if x is None or x in (")", "AND", "OR", "NOT"):
            raise QueryError(f"a term is missing in {query!r}")
        take()
        if x == "(":
            inner = either()
            if peek() != ")":
                raise QueryError(f"a parenthesis is open in {query!r}")
            take()
            return inner
        if x.startswith('"'):
            words = tuple(re.findall(r"[^\W_]+", fold(x)))
            if not words:
                raise QueryError("an empty phrase")
            return Node("phrase" if len(words) > 1 else "term", words)
        if not re.fullmatch(r"\w+\*?", x):
            raise QueryError(f"unquoted marks in {x!r}")
        return Node("prefix", (fold(x[:-1]),)) if x.endswith("*") else Node("term", (fold(x),))

    def without() -> Node:
        left = atom()
        while peek() == "NOT":
            take()
            left = Node("not", (), (left, atom()))
        return left

    def both() -> Node:
        parts = [without()]
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", (), tuple(parts))

    def either() -> Node:
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", (), tuple(parts))

    out = either()
    if at < len(items):
        raise QueryError(f"unexpected {items[at]!r}")
    return out


def _leaf_hits(post: DataFrame, leaf: Node) -> DataFrame:
    """doc, f: occurrences of a term, prefix or phrase."""
    if leaf.op == "prefix":
        return post.where(F.col("term").startswith(leaf.words[0])).groupBy("doc").agg(F.count(F.lit(1)).alias("f"))
    if leaf.op == "term":
        return post.where(F.col("term") == leaf.words[0]).groupBy("doc").agg(F.count(F.lit(1)).alias("f"))
    # a phrase occurs where every one of its words stands at its distance from the start
    places = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(leaf.words)))
    rows = post.where(F.col("term").isin(*set(leaf.words))).select("doc", "col", "pos", "term", F.inline(places)).where("term = w")
    starts = rows.groupBy("doc", "col", (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(leaf.words))
    return starts.groupBy("doc").agg(F.count(F.lit(1)).alias("f"))


def issue_columns(wide: DataFrame) -> list[str]:
    """The indexed columns that the wide view has."""
    return [c for c in ISSUE_COLUMNS if c in wide.columns]


def issue_postings(wide: DataFrame) -> DataFrame:
    """Postings of the wide view over all indexed columns, keyed by issue_key; columns it lacks are empty."""
    return postings(wide, "issue_key", issue_columns(wide))


def comment_postings(comments: DataFrame) -> DataFrame:
    """Postings of the comments, keyed by comment_id."""
    return postings(comments.where("comment_id is not null"), "comment_id", COMMENT_COLUMNS)


def search(post: DataFrame, query: str | Node, columns: list[str] | None = None, limit: int | None = None, *, order: str = "best", sizes: DataFrame | None = None) -> DataFrame:
    """doc, rank: matching documents; lower is better. ``order='reference'`` lists the worst first. ``sizes``: a stored table of :func:`lengths`."""
    tree = parse(query) if isinstance(query, str) else query
    leaves = list(dict.fromkeys(tree.leaves()))
    inside = post.where(F.col("col").isin(*columns)) if columns else post
    sizes = lengths(post) if sizes is None else sizes
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    tagged = None
    for i, leaf in enumerate(leaves):
        hits = _leaf_hits(inside, leaf).withColumn("leaf", F.lit(i))
        tagged = hits if tagged is None else tagged.unionByName(hits)
    per = tagged.groupBy("doc").agg(*(F.coalesce(F.sum(F.when(F.col("leaf") == i, F.col("f"))), F.lit(0)).alias(f"f{i}") for i in range(len(leaves))))
    n = per.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(leaves)))).first()

    def holds(node: Node) -> Column:
        if node.words:
            return F.col(f"f{leaves.index(node)}") > 0
        parts = [holds(p) for p in node.parts]
        if node.op == "not":
            return parts[0] & ~parts[1]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out

    rank = F.lit(0.0)
    for i in range(len(leaves)):
        idf = F.log((F.lit(float(total["n"])) - n[f"n{i}"] + 0.5) / (n[f"n{i}"] + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{i}")
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(total["avg"])))
    out = per.where(holds(tree)).join(sizes, "doc").select("doc", rank.alias("rank"))
    if limit is not None:
        out = out.orderBy(F.asc("rank") if order == "best" else F.desc("rank"), "doc").limit(limit)
    return out


def search_any_column(post: DataFrame, query: str, columns: list[str], limit: int | None = None, *, order: str = "best", sizes: DataFrame | None = None) -> DataFrame:
    """The query holds inside one of the columns; the best rank over columns counts."""
    out = None
    for c in columns:
        one = search(post, query, [c], sizes=sizes)
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("doc").agg(F.min("rank").alias("rank"))
    return out if limit is None else out.orderBy(F.asc("rank") if order == "best" else F.desc("rank"), "doc").limit(limit)


def inconsistencies(df: DataFrame, doc: str, columns: list[str], stored: DataFrame) -> DataFrame:
    """(doc, stored, fresh) of documents whose stored postings aren't those of a recount: their numbers, which are equal where only the content differs."""
    print_ = F.sum(F.xxhash64("col", "term", "pos").cast("decimal(38,0)"))  # of a bag of postings, whatever the order
    count = [F.count(F.lit(1)).alias("n"), print_.alias("print")]
    fresh = postings(df, doc, columns).groupBy("doc").agg(*count).withColumnsRenamed({"n": "fresh", "print": "fresh_print"})
    old = stored.groupBy("doc").agg(*count).withColumnsRenamed({"n": "stored", "print": "stored_print"})
    same = F.col("stored_print").eqNullSafe(F.col("fresh_print")) & F.col("stored").eqNullSafe(F.col("fresh"))
    return old.join(fresh, "doc", "full").where(~same).select("doc", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
