"""Host-level quality rules.

Every document gets rule figures; failures are summed by host and rule; each rule's host
rates are shrunk towards an empirical beta prior fitted to that rule over all hosts; the
host verdicts are joined back to the documents.

Two passes over the text and no shuffle of it: the first pass sends one partial
sum a task and host through the exchange, the second computes the figures again
beside the joined verdicts. Recomputing is cheaper than storing text twice, and a
lost executor only repeats its own splits.

Defined cases: a null text has no words and fails; an empty table gives an empty
result; a null host is a host of its own; repeated rows count once each; columns
of the input named like a result are replaced by it, and no other name clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from corvidex.llm.names import quoted, unused
from corvidex.plans.shared import arrow_batches, as_text, dropped, join_small, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_ODD = np.uint64(0x9E3779B97F4A7C15)

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("short_rate", "repeat_rate", "symbol_rate", "host_rate")
_FIGURES = T.StructType([T.StructField(c, T.LongType()) for c in FIGURES])


@dataclass(frozen=True)
class Rules:
    """Thresholds. The first two are the base rules."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    #: A host goes when its shrunk failure rate exceeds this.
    max_host_rate: float = 0.5
    #: Prior strength (pseudo-documents) when hosts don't differ measurably, and its bounds.
    default_strength: float = 20.0
    max_strength: float = 10_000.0


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more in the text.

    Rolling 64-bit window hashes only nominate positions; nominated windows are
    compared word by word, so the count is exact.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        acc = acc * _ODD + h[k : k + n]
    order = np.argsort(acc, kind="stable")
    same = acc[order][1:] == acc[order][:-1]
    if not same.any():
        return 0
    flag = np.zeros(n, dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    at = np.flatnonzero(flag).tolist()
    first: dict[tuple[bytes, ...], int] = {}
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for i in at:
        key = tuple(words[i : i + width])
        j = first.setdefault(key, i)
        if j != i:
            cover[i] += 1
            cover[i + width] -= 1
            if j >= 0:
                cover[j] += 1
                cover[j + width] -= 1
                first[key] = -1  # its first place is covered already
    return int((np.cumsum(cover[:-1]) > 0).sum())


def figures_of(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # of bytes: exactly the blanks of the word pattern
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, _BLANKS))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


@arrow_udf(_FIGURES)
def rule_figures(text: pa.Array) -> pa.Array:
    rows = [figures_of(t or b"") for t in text.cast(pa.binary()).to_pylist()]
    columns = list(zip(*rows, strict=True)) or [()] * len(FIGURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FIGURES))


def base_failed(f: Column, rules: Rules = Rules()) -> Column:
    return (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_pct * f["n_words"])


def junk(f: Column, rules: Rules = Rules()) -> Column:
    """Markup or symbol debris: too many symbols for the characters in words."""
    return 100 * f["n_symbols"] > rules.max_symbol_pct * f["word_chars"]


def failures(f: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """What a document fails, by rule; ``host`` is any of them."""
    short, repeats = f["n_words"] < rules.min_words, 100 * f["n_repeat_words"] > rules.max_repeat_pct * f["n_words"]
    return {"short": short, "repeat": repeats, "symbol": junk(f, rules), "host": short | repeats | junk(f, rules)}


def prior(mean: float | None, var: float | None, inv: float | None, rules: Rules = Rules()) -> tuple[float, float]:
    """(mean, strength) of the beta prior by the moments of raw host rates: their mean, variance and the mean of 1 / documents."""
    mean, var = mean or 0.0, var or 0.0
    # what binomial sampling alone explains doesn't speak for differing hosts
    extra = max(var - mean * (1 - mean) * (inv or 0.0), 0.0)
    strength = mean * (1 - mean) / extra - 1 if extra > 0 and 0 < mean < 1 else rules.default_strength
    return mean, min(max(strength, 1.0), rules.max_strength)


def host_verdicts(docs: DataFrame, *, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """host, n_docs, short_rate, repeat_rate, symbol_rate, host_rate (any rule), host_rejected; one row a host, written to the shared folder.

    Every rule has its own rates, prior and shrinkage; a host is rejected if one of its shrunk rates is above the limit.
    """
    f = F.col("f")
    names = list(failures(f, rules))
    hosts = written(
        docs.select(F.col(quoted(host)).alias("host"), rule_figures(as_text(F.col(quoted(text)))).alias("f"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), *(F.coalesce(F.count_if(c), F.lit(0)).alias(f"n_{k}") for k, c in failures(f, rules).items())),
        "hosts",
    )
    # moments of the raw rates over hosts, each host weighing alike
    raw = {k: F.col(f"n_{k}") / F.col("n_docs") for k in names}
    m = hosts.agg(F.avg(1 / F.col("n_docs")).alias("inv"), *(F.avg(c).alias(f"mean_{k}") for k, c in raw.items()), *(F.var_samp(c).alias(f"var_{k}") for k, c in raw.items())).first()
    rates = []
    for k in names:
        mean, strength = prior(m[f"mean_{k}"], m[f"var_{k}"], m["inv"], rules)
        rates.append(((F.col(f"n_{k}") + mean * strength) / (F.col("n_docs") + strength)).alias(f"{k}_rate"))
    shrunk = hosts.select("host", "n_docs", *rates)
    out = written(shrunk.withColumn("host_rejected", F.greatest(*(F.col(f"{k}_rate") for k in names)) > rules.max_host_rate), "verdicts")
    dropped(hosts)
    return out


def _judged(docs: DataFrame, text: str, host: str, rules: Rules) -> tuple[DataFrame, Column, Column, Column]:
    """docs with columns of our own, and those: the figures, the host's rates, the verdict. No shuffle of the documents."""
    arrow_batches(docs.sparkSession)
    name, figures, rates, rejected = unused(docs, "host", "figures", "rates", "rejected")
    verdicts = host_verdicts(docs, text=text, host=host, rules=rules).select(F.struct(F.col("host").alias("h")).alias(name), F.struct(*RATES).alias(rates), F.col("host_rejected").alias(rejected))
    # a struct key makes null hosts equal in an ordinary equi-join
    rows = docs.withColumn(name, F.struct(F.col(quoted(host)).alias("h"))).withColumn(figures, rule_figures(as_text(F.col(quoted(text)))))
    f = F.col(figures)
    ok = ~base_failed(f, rules) & ~junk(f, rules) & ~F.coalesce(F.col(rejected), F.lit(False))
    return join_small(rows, verdicts, [name], "left"), f, F.col(rates), ok


def keep_good(docs: DataFrame, *, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    rows, _, _, ok = _judged(docs, text, host, rules)
    return rows.where(ok).select(*(F.col(quoted(c)) for c in docs.columns))


def quality_rules(docs: DataFrame, *, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the five figures, base_failed, kept and the host's four rates; columns of these names in the input give way to them.

    kept is false if a base rule fails, the text is symbol debris, or one of the host's
    shrunk failure rates is above the limit.
    """
    ours = [*FIGURES, "base_failed", "kept", *RATES]
    rows, f, rates, ok = _judged(docs, text, host, rules)
    return rows.select(
        *(F.col(quoted(c)) for c in docs.columns if c.lower() not in ours),
        *(f[c].alias(c) for c in FIGURES),
        base_failed(f, rules).alias("base_failed"),
        ok.alias("kept"),
        *(rates[c].alias(c) for c in RATES),
    )
