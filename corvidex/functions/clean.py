"""Cleaning of text and of delimited values, as functions Column -> Column.

All of them are regular expressions evaluated in generated code. Blank means the
six ASCII blanks; lengths are in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an entity, a tag, a mark, a URL.
ENTITY = "&[a-zA-Z][a-zA-Z0-9]{0,20};"
TAG = "<[^>]{0,1000}>"
#: Anything but ASCII letters and digits, blanks, dash, underscore and dot: ``[^\w\s\-_.]``, said as ranges, which the JVM matches some twenty times as fast.
MARKS = r"[\x00-\x08\x0E-\x1F!-,/:-@\[-\x5E`{-\x{10FFFF}]"
HTTP_URL = r"^https?://[^\s]{1,200}\.[^\s]{1,50}"
DOMAIN = r"^[a-zA-Z0-9-]{1,63}\.[a-zA-Z]{2,10}"


def nonempty(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def numeric_suffix(key: Column) -> Column:
    """Integer after the first dash (the whole key without one); text that isn't a number is 0."""
    tail = F.substring(key, F.instr(key, "-") + 1, F.length(key))
    return F.coalesce(F.regexp_extract(tail, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def clean_attribute(value: Column) -> Column:
    """Line breaks out, ``&amp;`` decoded, outer spaces off; null as empty."""
    v = F.coalesce(value, F.lit(""))
    for old, new in (("\n", ""), ("\r", ""), ("&amp;", "&")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return F.trim(v)


def clean_text(text: Column, max_chars: int | None = None) -> Column:
    """Entities, tags and marks as spaces, blanks collapsed. ``max_chars``: reads only so many; whole texts by default."""
    t = F.coalesce(text if max_chars is None else F.left(text, F.lit(max_chars)), F.lit(""))
    for pattern in (ENTITY, TAG, r"\s+", MARKS):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def clean_text_simple(text: Column) -> Column:
    """The fallback: runs of anything but letters, digits, dot, dash and underscore become a space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_.\-]+", " "))


def url_stem(url: Column) -> Column:
    """Last path segment up to its first dot; the value itself where it isn't a URL or has no such segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    stem = F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
    return F.when(stem != "", stem).otherwise(url)


def malformations(value: Column) -> Column:
    """Names of what is wrong with a delimited value, in fixed order."""
    # The names and their order.
    tests = (
        ("double commas", value.contains(",,")),
        ("leading comma", value.startswith(",")),
        ("trailing comma", value.endswith(",")),
        ("triple+ commas", value.contains(",,,")),
        ("spaced multiple commas", value.rlike(r",\s*,\s*,")),
        ("mixed separators", value.rlike("[,;]{2,}")),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))


def clean_url(v: Column) -> Column:
    v = F.regexp_replace(v, r"[\s<>\"']+", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^\.+", ""), r"\.+$", "")
    bare = (v != "") & ~v.contains("://") & v.contains(".") & ~v.contains("/") & (F.length(v) < 100)
    return F.when(bare, F.concat(F.lit("http://"), v)).otherwise(v)


def clean_artifact(v: Column) -> Column:
    v = F.regexp_replace(v, r"[\r\n\t]", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\\+", "/"), "/+", "/")
    v = F.trim(F.regexp_replace(v, r"[<>\"'|*?]", ""))
    v = F.when(v.rlike("^[a-zA-Z]:|^/[a-zA-Z]"), v).otherwise(F.regexp_replace(F.regexp_replace(v, "^/+", ""), "/+$", ""))
    return F.when(F.regexp_replace(v, r"[/\\]", "") == "", F.lit("")).otherwise(v)


def clean_page(v: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(v, r"[\r\n\t]", " "), r"\s+", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"[<>\"']", ""), r"[\x00-\x1F\x7F-\x9F]", "")
    return F.trim(F.regexp_replace(v, " +", " "))


@dataclass(frozen=True)
class ListRules:
    """Bounds of delimited values."""

    # The bounds.
    max_field: int = 50_000
    max_values: int = 1_000
    max_value: int = 2_000
    min_value: int = 1


CLEANERS = {"related_url": clean_url, "related_artifacts": clean_artifact, "related_pages": clean_page}


def sanitize_list(value: Column, field: str | None = None, rules: ListRules = ListRules()) -> Column:
    """array<string> of a comma or semicolon list: split, blanks collapsed, empties out, values cleaned by field."""
    parts = F.split(F.left(F.coalesce(value, F.lit("")), F.lit(rules.max_field)), "[,;]+")
    parts = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= max(1, rules.min_value))
    parts = F.slice(parts, 1, rules.max_values)
    clean = CLEANERS.get(field or "", lambda x: x)
    return F.filter(F.transform(parts, lambda x: clean(F.left(x, F.lit(rules.max_value)))), lambda x: F.length(x) >= rules.min_value)


def related_values(url: Column, artifacts: Column, pages: Column) -> Column:
    """Distinct values of the three lists in order of first sight."""
    return F.array_distinct(F.concat(sanitize_list(url, "related_url"), sanitize_list(artifacts, "related_artifacts"), sanitize_list(pages, "related_pages")))


def valid_url(v: Column) -> Column:
    ok = F.when(v.rlike("^https?://"), v.rlike(HTTP_URL)).otherwise(v.rlike(DOMAIN))
    return F.coalesce(F.length(v).between(3, 2000) & ok, F.lit(False))


def valid_url_by_characters(v: Column) -> Column:
    after = F.regexp_extract(v, "^https?://(.*)$", 1)
    ok = F.when(v.rlike("^https?://"), after.contains(".") & (F.length(after) > 3)).otherwise(v.contains(".") & F.length(v).between(4, 499))
    return F.coalesce((F.length(v) >= 3) & ok, F.lit(False))


def shortened(v: Column, n: int = 200) -> Column:
    return F.when(F.length(v) > n, F.concat(F.left(v, F.lit(n)), F.lit("..."))).otherwise(v)
