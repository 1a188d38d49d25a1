"""Tokens of a text as array columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.clean import MARKS, clean_text
from corvidex.functions.terms import CAPITALS, OPERATIONS
from corvidex.plans.shared import checked, written

# Words that carry no content, never kept by the tokenizers below.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on "
    "once only or other our out over own same she should so some such than that the their them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your"
).split()
# Tokens of links that mean nothing.
LINK_WORDS = ("http", "https", "www", "com", "org", "net")
# Suffixes in the order in which they are tried.
SUFFIXES = ("ing", "ed", "er", "est", "ly", "ion", "tion", "ation", "ness", "ment")


#: Runs of anything but lower-case ASCII letters, digits and underscores: ``[^a-z0-9_]+``, said as ranges for speed.
NO_WORD = r"[\x00-/:-\x5E`{-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda t: t != "")


def plain_tokens(text: Column, min_length: int = 2, max_length: int = 30, stop: list[str] = STOP_WORDS) -> Column:
    """Blank-separated tokens of letters, digits, dash, underscore and dot; no pure numbers, no stop words."""
    marks = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, " ")
    return F.filter(F.split(marks, r"\s+"), lambda t: F.length(t).between(min_length, max_length) & ~t.rlike(r"^\d+$") & ~t.isin(*stop))


def counted(tokens: Column) -> Column:
    """Array of (term, tf, len) of an array of tokens: how often each occurs, and how many tokens there are. Runs of the sorted array, so no shuffle."""

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value), with the value computed once however often f names it."""
        return F.transform(F.array(value), f)[0]

    def runs(x: Column) -> Column:
        n = F.size(x)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get(x, i).eqNullSafe(F.get(x, i - 1)))
        run = lambda at: lambda i, k: F.struct(F.get(x, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("long").alias("tf"), n.cast("long").alias("len"))
        return F.when(n > 0, bound(starts, lambda at: F.transform(at, run(at))))

    return bound(F.sort_array(tokens), runs)


def valid_token(t: Column, min_length: int = 2, max_length: int = 50) -> Column:
    return F.length(t).between(min_length, max_length) & ~t.rlike("^[0-9]+$") & t.rlike("(?i)[a-z0-9]") & ~t.isin(*LINK_WORDS)


def valid_token_by_characters(t: Column, min_length: int = 2, max_length: int = 50) -> Column:
    """The same rule for tokens that no pattern may see: letters and digits are told by what is left when they are taken out."""
    digits = "0123456789"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    without_digits, plain = F.length(F.translate(t, digits, "")), F.length(F.translate(t, letters + digits, ""))
    return F.length(t).between(min_length, max_length) & ~t.isin(*LINK_WORDS) & (without_digits > 0) & (plain < F.length(t))


def preserve_terms(tokens: Column, terms: list[str], verbatim: list[str] = ()) -> Column:
    """Domain terms in upper case (``verbatim`` ones as they are). Long term lists: join with a table instead."""
    if not terms:
        return tokens

    def one(t: Column) -> Column:
        known = F.when(F.lower(t).isin(*terms), F.upper(t)).otherwise(t)
        return F.when(F.lower(t).isin(*verbatim), t).otherwise(known) if verbatim else known

    return F.transform(tokens, one)


def stem_exempt(t: Column) -> Column:
    return ((t == F.upper(t)) & (F.length(t) > 1)) | t.startswith("$") | t.rlike("[-._]")


def simple_stem(t: Column) -> Column:
    """The first suffix that leaves three letters or more is cut; words of three letters stay."""
    out = t
    for s in reversed(SUFFIXES):
        out = F.when(t.endswith(s) & (F.length(t) - len(s) >= 3), F.left(t, F.length(t) - len(s))).otherwise(out)
    return F.when(F.length(t) <= 3, t).otherwise(out)


def fallback_tokens(text: Column, min_length: int = 2, max_length: int = 50) -> Column:
    """Six entities decoded, split at delimiters, numbers and marks out."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # The entities and what they stand for.
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    parts = F.split(t, r"""[\s,;.:!?()\[\]{}"'<>=+\-*/\\|@#$%^&~`]+""")
    return F.filter(parts, lambda x: F.length(x).between(min_length, max_length) & ~x.rlike("^[0-9]+$") & x.rlike("[a-z0-9]"))


def preprocessed(text: Column, terms: list[str] = CAPITALS, min_length: int = 2, max_length: int = 50) -> Column:
    """Clean, lower, split, stop words out, validity, domain terms; unstemmed."""
    kept = F.filter(words(clean_text(text)), lambda t: ~t.isin(*STOP_WORDS) & valid_token(t, min_length, max_length))
    return preserve_terms(kept, list(terms), OPERATIONS)


def preprocessed_terms(docs: DataFrame, text: Column, terms: list[str] = CAPITALS) -> DataFrame:
    """term: the different tokens of :func:`preprocessed` in all texts, written.

    Texts are split once; what is kept and how it is written is told once a distinct word, not once an occurrence.
    """
    raw = docs.select(F.explode(F.split(F.lower(clean_text(text)), NO_WORD)).alias("w")).distinct()
    kept = raw.where(~F.col("w").isin(*STOP_WORDS) & valid_token(F.col("w")))
    return written(kept.select(preserve_terms(F.array("w"), list(terms), OPERATIONS)[0].alias("term")).distinct(), "words")


# --- Porter's algorithm (1980), over distinct terms only -----------------------------------------

_VOWELS = "aeiou"
# Suffix replacements of steps 2, 3 and 4 of the published algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


def _longest(w: str, table: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    return max((rule for rule in table if w.endswith(rule[0])), key=lambda x: len(x[0]), default=None)


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (rule := _longest(w, table)) and _measure(w[: -len(rule[0])]) > 0:
            w = w[: -len(rule[0])] + rule[1]
    ends = [s for s in _STEP4 if w.endswith(s)] + (["ion"] if w.endswith(("sion", "tion")) else [])
    if ends and _measure(w[: -len(max(ends, key=len))]) > 1:
        w = w[: -len(max(ends, key=len))]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(terms: DataFrame, term: str = "term", stem: Callable[[str], str] = porter) -> DataFrame:
    """``terms`` with a column stem. The Python code runs once a distinct term, not once an occurrence, and the terms are made once."""
    distinct = written(terms.select(term).distinct(), "terms")
    exempt = stem_exempt(F.col(term))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({term: b[term], "stem": b[term].map(stem)})

    made = distinct.where(~exempt).mapInPandas(run, f"{term} string, stem string").unionByName(distinct.where(exempt).withColumn("stem", F.col(term)))
    return terms.join(made, term, "left")


def stemmed_tokens(docs: DataFrame, doc: str, tokens: Column, stem: Callable[[str], str] = porter) -> DataFrame:
    """doc, tokens: an array of stems in order, for every document: clean, lower, split, stop words, validity, domain terms, then stems.

    Stems are made once a distinct term and joined back to the occurrences; the join's small side is a written table.
    """
    rows = docs.select(F.col(doc).alias("doc"), tokens.alias("t"))
    terms = written(stemmed(rows.select(F.explode("t").alias("term")).distinct(), "term", stem), "stems")
    said = rows.select("doc", F.posexplode("t").alias("pos", "term")).join(checked(terms), "term")
    lists = said.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]).alias("tokens"))
    return docs.select(F.col(doc).alias("doc")).join(lists, "doc", "left").select("doc", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
