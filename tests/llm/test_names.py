"""Input columns named like an operator's own: they come back as they were."""

import pytest
from pyspark.sql import functions as F

from corvidex.llm import mixing, names, ngram_join, quality_rules, secrets

OWN = [
    "_host", "_f", "_figures", "_rate", "_ok", "host_rejected", "_rejected", "host", "_key", "_k", "_size", "_taken", "_words", "_rows", "_part", "__part", "size", "src", "tie", "bin", "plan", "_gone", "_again",
    "_lost", "_twice", "_keeper", "_set", "_text", "_n", "_digest", "digest", "n_shingles", "component_id", "_s", "_p", "_t", "_end", "_found", "_spots", "_clean", "FOUND", "cand", "a.b", "c`d",
]


@pytest.fixture(scope="module")
def crowded(spark):
    good = "plain words that say a little more than twenty words do when one counts them all again and then some more of it"
    rows = [(i, f"{good} {i} password=abcdef{i}", "en", f"s{i % 2}", None) for i in range(8)]
    rows += [(3, good + " of another kind entirely " * 2, "en", "s0", None), (None, good, "en", None, None), (None, good, "en", None, None), (50, None, None, None, None)]
    columns = ", ".join(f"`{n.replace('`', '``')}` string" for n in OWN)
    return spark.createDataFrame([(*r, *OWN) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {columns}").repartition(2)


@pytest.mark.parametrize("f", [quality_rules.keep_good, ngram_join.one_of_each, secrets.redacted, mixing.mixed_documents])
def test_rows_keep_their_columns(crowded, f):
    out = f(crowded)
    assert out.columns == crowded.columns
    rows = out.collect()
    assert rows and all(list(r[5:]) == OWN for r in rows)


def test_results_over_crowded_tables(crowded):
    n = crowded.count()
    rows = quality_rules.quality_rules(crowded)
    assert rows.count() == n and all(r["c`d"] == "c`d" and r["_f"] == "_f" for r in rows.collect())
    assert mixing.mix(crowded).count() == n and ngram_join.components(crowded).count() == n and secrets.scan(crowded).count() == n


def test_unused(spark):
    df = spark.range(1).select(F.lit(1).alias("_A"), F.lit(2).alias("__b"))
    assert names.unused(df, "a", "b") == ["___a", "___b"]
