"""Secret scans by a randomness test battery; DataFrame operations only.

Three base patterns give spans that always stay. Beyond them, every maximal run of
token characters (``MIN_RUN`` or more) is a candidate. Its encoding is inferred as
the smallest alphabet holding all its letters and digits (marks such as ``-`` in a UUID
only part it), and three tests compare it with ordinary text written in that alphabet
(the null hypothesis):

* chi-squared alphabet uniformity: text repeats its frequent letters, so its
  statistic exceeds that of a random string by an amount growing with length;
* runs: text changes between classes of characters at another rate than a random
  string: between digits, upper and lower case more seldom; in alphabets of one case,
  between vowels and consonants more often; in digits, between low and high more seldom;
* serial correlation: neighbours in a random string don't depend on each other; what a
  correlation (sequences, repeats) is beyond chance speaks against randomness.

They add up to one z-score and p-value. False discoveries are held near ``FDR`` by
Benjamini-Hochberg within length classes, over the candidates of the whole input: a
short run has little evidence and competes with short runs only. p-values are rounded
up to steps of a tenth of a decade, so that ranks come from a small histogram and no
candidate list is sorted or collected. The null's figures in ``ALPHABETS`` are fitted to
ordinary runs of every kind in the test (joined words, identifiers, paths, dates).

Work is linear in the length of a run, whose parts are bound once; matches of a text are
placed in blocks of ``PLACED``.

Positions are in code points: the pieces between matches and the matches alternate,
so running sums of their lengths give every span.

Defined cases: null and empty texts have no spans; runs overlapping a base span are
not added; a run of fewer than ``MIN_CORE`` letters and digits is never added; repeated
rows count as candidates once each; an empty table has an empty result; only the named
columns are read, and no name of the input clashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.llm.names import quoted, unused
from corvidex.plans.shared import as_text, written

# The three base patterns, in their listed order.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 6, 20

MIN_RUN, MIN_CORE = 20, 16
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN
FDR = 0.01
#: Upper ends of the length classes.
CLASSES = (24, 32, 48)
STEPS = 400
PLACED = 256
#: (name, characters, size, excess of chi-squared a character that text shows in it, share of changes of class that text shows in it)
ALPHABETS = (
    ("digits", "[0-9]", 10, 2.0, 0.33),
    ("hex", "[0-9a-f]", 16, 1.5, 0.20),
    ("HEX", "[0-9A-F]", 16, 1.5, 0.20),
    ("lower", "[a-z]", 26, 1.3, 0.58),
    ("upper", "[A-Z]", 26, 1.3, 0.58),
    ("base32", "[A-Z2-7]", 32, 1.4, 0.08),
    ("base36", "[0-9a-z]", 36, 1.7, 0.10),
    ("BASE36", "[0-9A-Z]", 36, 1.7, 0.10),
    ("letters", "[A-Za-z]", 52, 2.3, 0.33),
    ("base62", "[A-Za-z0-9]", 62, 2.8, 0.29),
)
ONE_CASE = ("lower", "upper")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDER = _DIGITS + _UPPER + _LOWER
_VOWEL = "".join("v" if c in "aeiou" else "c" for c in _LOWER)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, hit>> of all matches, leftmost and non-overlapping, end exclusive."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<s:int,e:int,hit:string>>")

    def many(hits: Column) -> Column:
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        blocks = bound(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PLACED).cast("int")), lambda i: F.slice(p, i * PLACED + 1, F.lit(PLACED))))
        return bound(blocks, placed)

    def placed(blocks: Column) -> Column:
        def total(block: Column) -> Column:
            return F.aggregate(block, F.lit(0), lambda a, x: (a + x["gap"] + F.length(x["hit"])).cast("int"))

        def after(acc: Column, n: Column) -> Column:
            return F.struct((acc["at"] + n).cast("int").alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

        starts = F.aggregate(F.transform(blocks, total), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), after)["starts"]
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step)["found"]))

    def step(acc: Column, x: Column) -> Column:
        s = (acc["at"] + x["gap"]).cast("int")
        e = (s + F.length(x["hit"])).cast("int")
        return F.struct(e.alias("at"), F.concat(acc["found"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit")))).alias("found"))

    # most texts have no match: one search settles them
    return F.when(text.rlike(pattern), bound(hits, many)).otherwise(none)


def chi_squared(run: Column, size: Column) -> Column:
    """size/n * sum(count^2) - n over the characters of ``run``."""
    squares = F.transform(F.array_distinct(F.split(run, "")), lambda c: F.pow((F.length(run) - F.length(F.replace(run, c, F.lit("")))).cast("double"), 2))
    return size / F.length(run) * F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) - F.length(run)


def correlation(run: Column) -> Column:
    """Serial correlation of neighbours by their places in the alphabet; 1 for a constant run."""

    def of(at: Column) -> Column:
        return bound(F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / F.size(at), lambda mean: about(at, mean))

    def about(at: Column, mean: Column) -> Column:
        var = F.aggregate(at, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2))
        products = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: (a - mean) * (b - mean))
        return bound(var, lambda v: F.when(v > 0, F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / v).otherwise(1.0))

    return bound(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(_ORDER), c).cast("double")), of)


def battery(run: Column) -> Column:
    """struct<step of the p-value, encoding> of a candidate."""
    short = F.struct(F.lit(0).alias("step"), F.lit("").alias("encoding"))

    def of(core: Column) -> Column:
        return F.when(F.length(core) < MIN_CORE, short).otherwise(bound(_which(core), lambda k: _tests(core, k)))

    return bound(F.regexp_replace(run, "[^A-Za-z0-9]", ""), of)


def _which(core: Column) -> Column:
    which = F.lit(len(ALPHABETS) - 1)
    for i in reversed(range(len(ALPHABETS) - 1)):
        which = F.when(core.rlike(f"^{ALPHABETS[i][1]}+$"), F.lit(i)).otherwise(which)
    return which


def _tests(core: Column, k: Column) -> Column:
    def of(j: int) -> Column:
        return F.element_at(F.array(*(F.lit(a[j]) for a in ALPHABETS)), k + 1)

    n, size, excess, change = F.length(core).cast("double"), of(2).cast("double"), of(3).cast("double"), of(4).cast("double")
    one_case = of(0).isin(*ONE_CASE)
    kinds = (
        F.when(one_case, F.translate(F.lower(core), _LOWER, _VOWEL))
        .when(of(0) == "digits", F.translate(core, _DIGITS, "l" * 5 + "h" * 5))
        .otherwise(F.translate(core, _ORDER, "d" * 10 + "U" * 26 + "l" * 26))
    )
    changes = F.regexp_count(kinds, F.lit(r"(.)(?=.)(?!\1)")).cast("double")
    z_chi = ((size - 1) + (n - 1) * excess - chi_squared(core, size)) / F.sqrt(2 * (size - 1) + 4 * (n - 1) * excess)
    more = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    z_runs = F.when(one_case, -more).otherwise(more)
    r = F.least(F.abs(correlation(core)), F.lit(0.999))
    z_serial = bound(r, lambda x: F.least(F.lit(0.0), 2 - 0.5 * F.log((1 + x) / (1 - x)) * F.sqrt(n - 3)))
    # 1.5 rather than the root of 2: the first two go together in text
    return bound((z_chi + z_runs + z_serial) / 1.5, lambda z: F.struct(F.when(z > 0, _step(z)).otherwise(0).alias("step"), of(0).alias("encoding")))


def _step(z: Column) -> Column:
    """Tenths of decades of a bound of the normal tail, down to the next step, so p is never smaller than it was."""
    return F.least(F.floor((0.717 * z + 0.416 * z * z + 0.693) * (10 / 2.302585092994046)), F.lit(STEPS)).cast("int")


def length_class(run: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i in reversed(range(len(CLASSES))):
        out = F.when(F.length(run) <= CLASSES[i], F.lit(i)).otherwise(out)
    return out


def scanned(text: Column) -> Column:
    """struct<assign, access, hex: base spans; run: the runs> of one text, each an array<struct<s, e, hit>>."""
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    assign = bound(values, lambda v: F.filter(spans(text, ASSIGN), lambda x, i: F.get(v, i) >= MIN_VALUE))
    access = F.filter(spans(text, ACCESS), lambda x: F.length(x["hit"]) >= MIN_ACCESS)
    return F.struct(assign.alias("assign"), access.alias("access"), spans(text, HEX).alias("hex"), spans(text, RUN).alias("run"))


def tested(s: Column) -> Column:
    """The candidates of :func:`scanned`: runs that no base span overlaps, with their tests."""

    def alone(base: Column) -> Column:
        return F.filter(s["run"], lambda r: ~F.exists(base, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))

    cand = bound(F.concat(s["assign"], s["access"], s["hex"]), alone)
    return F.transform(cand, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), length_class(r["hit"]).alias("len_class"), battery(r["hit"]).alias("t")))


def limits(found: DataFrame) -> list[int]:
    """By length class the least step that Benjamini-Hochberg accepts, from a histogram of at most classes x steps rows. ``found`` has a column cand."""
    c = F.col("c")
    rows = found.select(F.explode("cand").alias("c")).groupBy(c["len_class"].alias("k"), c["t"]["step"].alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = []
    for k in range(len(CLASSES) + 1):
        steps = sorted(((r["step"], r["n"]) for r in rows if r["k"] == k), reverse=True)
        total, rank, best = sum(n for _, n in steps), 0, STEPS + 1
        for step, n in steps:
            rank += n
            if total * 10 ** (-step / 10) <= FDR * rank:
                best = step
        out.append(best)
    return out


def added(cand: Column, least: list[int]) -> Column:
    return F.filter(cand, lambda c: c["t"]["step"] >= F.element_at(F.array(*(F.lit(x) for x in least)), c["len_class"] + 1))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, assign, access, hex, random: arrays of struct<s, e>; one row a document, texts read once."""
    body = as_text(text)
    base = docs.select(F.col(doc_id).alias("doc_id"), scanned(body).alias("s"))
    thin = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    s = F.col("s")
    found = written(base.select("doc_id", *(thin(s[k]).alias(k) for k in KINDS[:3]), tested(s).alias("cand")), "spans")
    least = limits(found)
    return found.select("doc_id", *KINDS[:3], thin(added(F.col("cand"), least)).alias("random"))


def listed(row: dict[str, Column]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    def ranked(k: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))

    every = F.concat(*(ranked(k, c) for k, c in row.items()))
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", name[x["k"]], x["s"], x["e"])), ",")


def redacted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` and n_chars following the new text.

    Two reads of the texts and no shuffle of them: the first finds the limits, the
    second applies them. Null texts stay null.
    """
    own = F.col(quoted(text))
    body = as_text(own)
    least = limits(docs.select(tested(scanned(body)).alias("cand")))
    found, spots, clean = unused(docs, "found", "spots", "clean")
    s, p, t = F.col(found), F.col(spots), F.col(clean)
    places = F.concat(*(F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for c in (s["assign"], s["access"], s["hex"], added(tested(s), least))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # a span inside one already cut adds nothing
        cut = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(F.concat(F.substring(own, acc["at"] + 1, x["s"] - acc["at"]), F.lit("[SECRET]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), cut.alias("out"))

    end = bound(F.aggregate(F.array_sort(p), start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(own, a["at"] + 1, F.length(own))))
    out = docs.withColumn(found, scanned(body)).withColumn(spots, places).withColumn(clean, F.when(F.size(p) == 0, own).otherwise(end))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(t.alias(c))
        elif c == n_chars:
            cols.append(F.when(F.size(p) > 0, F.length(t).cast(docs.schema[c].dataType)).otherwise(F.col(quoted(c))).alias(c))
        else:
            cols.append(F.col(quoted(c)))
    return out.select(*cols)
