"""Data-quality and operations rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvidex.functions.clean import malformations, sanitize_list
from corvidex.operators.fts import terms_of
from corvidex.sources.store import name_differences


def error_type(message: Column) -> Column:
    m = F.lower(message)
    # What a message holds and the type that makes it, first match counts.
    rules = (
        ("database|sqlite", "database_error"),
        ("timeout|timed out", "timeout_error"),
        ("memory|heap", "memory_error"),
        ("validation|invalid", "validation_error"),
        ("network|connection", "network_error"),
        ("system|enoent|permission", "system_error"),
    )
    out = F.lit("processing_error")
    for pattern, name in reversed(rules):
        out = F.when(m.rlike(pattern), name).otherwise(out)
    return out


def error_severity(message: Column, retries: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("critical|fatal|corrupt"), "critical").when((retries > 2) | m.rlike("timeout|memory"), "high").when((retries > 1) | m.rlike("database|network"), "medium").otherwise("low")


def rollup(events: DataFrame, by: str, top: int | None = None) -> DataFrame:
    out = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), by).limit(top)


def error_analysis(errors: DataFrame, now: Column, *, prefix: int = 100, messages: int = 5, issues: int = 10) -> DataFrame:
    """(kind, value, n) over (ts, type, severity, message, issue_key): all errors, those of the last hour, by type, by severity, the most frequent message starts and issues.

    One scan: every error is exploded into its entries, partial sums leave each task, and only
    the two lists are ranked.
    """
    hour = F.col("ts") > now - F.expr("interval 1 hour")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    entries = F.array(entry("total", F.lit("")), F.when(hour, entry("last hour", F.lit(""))), entry("type", F.col("type")), entry("severity", F.col("severity")), entry("message", F.left("message", F.lit(prefix))), F.when(F.col("issue_key").isNotNull(), entry("issue", F.col("issue_key"))))
    counts = errors.select(F.inline(F.array_compact(entries))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    listed = [counts.where(F.col("kind") == k).orderBy(F.desc("n"), "value").limit(top) for k, top in (("message", messages), ("issue", issues))]
    return counts.where(~F.col("kind").isin("message", "issue")).unionByName(listed[0]).unionByName(listed[1])


def loggable(value: Column, most: int = 200) -> Column:
    """A value as the error log shows it: text cut to ``most`` characters with three dots behind."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def loggable_row(df: DataFrame, most: int = 200) -> DataFrame:
    """Rows as the error log shows them: long text cut, nested values masked, the rest as it is."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        out.append((loggable(c, most) if kind == "string" else F.when(c.isNotNull(), F.lit("[Object]")) if kind in ("struct", "array", "map") else c).alias(f.name))
    return df.select(*out)


def valid_batch(docs: DataFrame, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(documents with a key, one row of counts: given, without a key, kept with a blank title)."""
    keyless = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    blank = F.coalesce(F.trim(title), F.lit("")) == ""
    counts = docs.agg(F.count(F.lit(1)).alias("given"), F.count_if(keyless).alias("keyless"), F.count_if(~keyless & blank).alias("untitled"))
    return docs.where(~keyless), counts


def recovered(items: DataFrame, key: str, value: Column, fallback: Column | None = None) -> DataFrame:
    """(key, value, status) of a conversion that gives null where it fails: ok, recovered by ``fallback``, or failed; items without a key are skipped.

    Conversions that would raise must be their try_ forms; the failure of one item never fails its task.
    """
    second = F.lit(None) if fallback is None else fallback
    status = F.when(F.col(key).isNull(), "skipped").when(value.isNotNull(), "ok").when(second.isNotNull(), "recovered").otherwise("failed")
    return items.select(F.col(key), F.when(status != "skipped", F.coalesce(value, second)).alias("value"), status.alias("status"))


def lock_report(events: DataFrame, operation: str, duration: str, top: int = 5, slow: float = 1.0) -> DataFrame:
    """operation, events, total, mean, longest, share of events longer than ``slow`` of the operations that took longest in all."""
    d = F.col(duration)
    out = events.groupBy(operation).agg(F.count(F.lit(1)).alias("events"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.max(d).alias("longest"), F.avg((d > slow).cast("double")).alias("slow_share"))
    return out.orderBy(F.desc("total"), operation).limit(top)


def recent(events: DataFrame, ts: str, now: Column, minutes: int) -> DataFrame:
    return events.where(F.col(ts) > now - F.expr(f"interval {minutes} minutes"))


def may_continue(errors: DataFrame, now: Column, max_errors: int = 50) -> DataFrame:
    """One row: whether work may go on, given (ts, type, severity) of the last five minutes."""
    last = recent(errors, "ts", now, 5)
    return last.agg((~((F.count_if(F.col("severity") == "critical") > 0) | (F.count(F.lit(1)) > max_errors) | (F.count_if(F.col("type") == "memory_error") > 3))).alias("may_continue"))


def rolling(events: DataFrame, part: list[str], order: list[str], value: str, rows: int = 1000) -> DataFrame:
    """Mean of the last ``rows`` + 1 values and running maximum, within ``part``."""
    w = Window.partitionBy(*part).orderBy(*order)
    return events.withColumn("rolling_avg", F.avg(value).over(w.rowsBetween(-rows, 0))).withColumn("running_max", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def batch_outcome(items: DataFrame, status: str = "status") -> DataFrame:
    """One row: processed, successful, failed, skipped; early stop and continue verdicts."""
    s = F.col(status)
    c = items.agg(F.count(F.lit(1)).alias("processed"), F.count_if(s == "ok").alias("successful"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))
    rate = F.try_divide(F.col("failed").cast("double"), "processed")
    return c.withColumn("stop_early", (F.col("processed") >= 100) & (rate > 0.5)).withColumn("can_continue", F.coalesce(rate < 0.8, F.lit(True)))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are null or empty."""
    return df.agg(*(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns))


def size_check(base: DataFrame, index: DataFrame) -> DataFrame:
    a, b = base.agg(F.count(F.lit(1)).alias("base_rows")), index.agg(F.count(F.lit(1)).alias("index_rows"))
    return a.join(b).withColumn("status", F.when(F.col("base_rows") == F.col("index_rows"), "PASS").when(F.col("index_rows") == 0, "FAIL").otherwise("WARNING"))


def suite(checks: DataFrame) -> DataFrame:
    """(name, status) -> one row: counts and health percentage."""
    s = F.col("status")
    return checks.agg(F.count_if(s == "PASS").alias("passed"), F.count_if(s == "WARNING").alias("warnings"), F.count_if(s == "FAIL").alias("failed"), F.round(100 * F.try_divide(F.count_if(s == "PASS").cast("double"), F.count(F.lit(1))), 2).alias("health"))


def list_quality(df: DataFrame, column: str, max_value: int = 2000, max_values: int = 1000) -> DataFrame:
    """One row: malformed, empty, over-long, over-full, needing cleaning, distinct values before and after."""
    c = F.col(column)
    raw = F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")
    clean = sanitize_list(c, column)
    return df.agg(
        F.count_if(F.size(malformations(c)) > 0).alias("malformed"), F.count_if(F.coalesce(c, F.lit("")) == "").alias("empty"),
        F.count_if(F.exists(raw, lambda x: F.length(x) > max_value)).alias("too_long"), F.count_if(F.size(raw) > max_values).alias("too_many"),
        F.count_if(~F.array_join(raw, ",").eqNullSafe(F.array_join(clean, ",")) & c.isNotNull()).alias("needs_cleaning"),
        F.sum(F.size(F.array_distinct(raw))).alias("unique_before"), F.sum(F.size(F.array_distinct(clean))).alias("unique_after"),
    )


def size_histogram(groups: DataFrame, size: str) -> DataFrame:
    """One row: groups by size class; a size of 50 is in two of them, as reported everywhere."""
    s = F.col(size)
    # The classes.
    classes = {"one": (1, 1), "two_to_5": (2, 5), "six_to_10": (6, 10), "eleven_to_50": (11, 50), "from_50": (50, None), "from_1000": (1000, None)}
    return groups.agg(*(F.count_if((s >= a) & (F.lit(True) if b is None else s <= b)).alias(n) for n, (a, b) in classes.items()))


def size_steps(groups: DataFrame, size: str) -> DataFrame:
    """One row: groups of at least 1, 10, 50 and 100."""
    return groups.agg(*(F.count_if(F.col(size) >= n).alias(f"from_{n}") for n in (1, 10, 50, 100)))


def health(active: int, total: int, timeouts: int, locks: int, mean_ms: float, reachable: bool = True) -> list[str]:
    """What is wrong with a store's counters, in words; empty if healthy."""
    rate = lambda n: n / total if total else 0.0
    checks = (
        (not reachable, "unreachable"),
        (active > 10, "too many active operations"),
        (rate(timeouts) > 0.10, "too many timeouts"),
        (rate(locks) > 0.20, "too many locks"),
        (mean_ms > 5000, "slow on average"),
    )
    return [name for bad, name in checks if bad]


def integrity(issues: DataFrame, attributes: DataFrame, comments: DataFrame, wide: DataFrame, post: DataFrame, *, word: str = "the", tables: tuple[list[str], list[str]] = ((), ()), columns: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """(name, n, status) of the 17 checks of a store; n counts the offending rows, or what is missing.

    ``post``: the stored postings of the titles, by issue_key. ``tables`` and ``columns``: expected and found
    names. All tables meet in one aggregate by issue key, comment ids in another, so each table is read once or twice.
    """
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    flags = ("blank_title", "no_time", "broken", "no_name", "no_body", "fresh", "fresh_print", "stored", "stored_print", "found")

    def part(df: DataFrame, at: str, key: str = "issue_key", **own: Column) -> DataFrame:
        n = {k: (own[k].cast("decimal(38,0)") if k in own else F.lit(0).cast("decimal(38,0)")) for k in flags}
        return df.select(F.col(key).alias("issue_key"), *(F.lit(int(at == t)).alias(t) for t in ("i", "a", "c", "w", "p")), *(n[k].alias(k) for k in flags))

    words = terms_of(F.coalesce("title", F.lit("")))
    print_of = F.aggregate(F.transform(words, lambda t, i: F.xxhash64(F.lit("title"), t, i).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda x, y: (x + y).cast("decimal(38,0)"))
    index = post.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("col", "term", "pos").cast("decimal(38,0)")).alias("print"), F.max((F.col("term") == word).cast("int")).alias("hit"))
    rows = (
        part(issues, "i", blank_title=(F.col("title").isNull() | (F.trim("title") == "")).cast("int"), no_time=F.col("created_at").isNull().cast("int"), broken=F.coalesce(F.contains("description", F.lit("\ufffd")), F.lit(False)).cast("int"), fresh=F.size(words), fresh_print=print_of)
        .unionByName(part(attributes, "a", no_name=empty("field_name").cast("int")))
        .unionByName(part(comments, "c", no_body=empty("body").cast("int")))
        .unionByName(part(wide, "w"))
        .unionByName(part(index, "p", key="doc", stored=F.col("n"), stored_print=F.col("print"), found=F.col("hit")))
    )
    by = rows.groupBy("issue_key").agg(*(F.sum(c).alias(c) for c in ("i", "a", "c", "w", "p", *flags)))
    alone = (F.col("i") == 0) | F.col("issue_key").isNull()
    ids = comments.where("comment_id is not null").groupBy("comment_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    total = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0))
    gap = lambda names: F.lit(len(name_differences(list(names[0]), list(names[1]))["missing"]))
    checks = (
        ("issue keys are unique", F.count_if(F.col("i") > 1), "FAIL"),
        ("issue keys are present", total("i", empty("issue_key")), "FAIL"),
        ("titles are present", total("blank_title"), "WARNING"),
        ("creation times are present", total("no_time"), "WARNING"),
        ("descriptions are intact", total("broken"), "WARNING"),
        ("comments have an issue", total("c", alone), "FAIL"),
        ("comments have a body", total("no_body"), "WARNING"),
        ("attributes have an issue", total("a", alone), "FAIL"),
        ("attributes have a name", total("no_name"), "FAIL"),
        ("every issue is in the wide view", total("i", (F.col("w") == 0) | F.col("issue_key").isNull()), "FAIL"),
        ("the wide view has one row an issue", F.count_if(F.col("w") > 1), "FAIL"),
        ("postings have an issue", total("p", alone), "FAIL"),
        ("the index agrees with its table", F.count_if((F.col("i") == 1) & ((F.col("fresh") != F.col("stored")) | (F.col("fresh_print") != F.col("stored_print")))), "FAIL"),
        ("the index finds a word", (total("found") == 0).cast("int"), "FAIL"),
        ("tables exist", gap(tables), "FAIL"),
        ("columns exist", gap(columns), "FAIL"),
    )
    one = by.agg(*(n.cast("long").alias(f"c{j}") for j, (_, n, _) in enumerate(checks)))
    out = one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"c{j}").alias("n"), F.lit(bad).alias("bad")) for j, (name, _, bad) in enumerate(checks)))))
    out = out.unionByName(ids.select(F.lit("comment ids are unique").alias("name"), "n", F.lit("FAIL").alias("bad")))
    return out.select("name", "n", F.when(F.col("n") == 0, "PASS").otherwise(F.col("bad")).alias("status"))
