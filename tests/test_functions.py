"""Functions on small literal inputs."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvidex.functions import clean, dates, tokens


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


CASES = {
    "related_url": [
        ("https://wiki.acme.net/a,,gopher://old.site,nodots, ", ["https://wiki.acme.net/a", "gopher://old.site", "nodots"]),
        (";;,acme.net,;,  http://two  words.acme.net ;", ["http://acme.net", "http://twowords.acme.net"]),
        ("..dotted.acme.net..,a/b.c", ["http://dotted.acme.net", "a/b.c"]),
        (None, []),
    ],
    "related_artifacts": [
        ("notes.md,/srv/data/x.csv,, plan.odt ,", ["notes.md", "/srv/data/x.csv", "plan.odt"]),
        ("\\share\\\\deep\\a.bin,q?u*e|s<t>.txt, two   blanks.png", ["/share/deep/a.bin", "quest.txt", "two blanks.png"]),
        ("", []),
    ],
    "related_pages": [
        ("Start,Terms of Use,, Help ,", ["Start", "Terms of Use", "Help"]),
        ("Line\nbreak,Tab\tstop,   wide   gap   ,", ["Line break", "Tab stop", "wide gap"]),
        ("<b>bold</b>,'single',\"double\"", ["bbold/b", "single", "double"]),
    ],
}


@pytest.mark.parametrize("field", CASES)
def test_sanitize(spark, field):
    assert column(spark, [v for v, _ in CASES[field]], lambda c: clean.sanitize_list(c, field)) == [w for _, w in CASES[field]]


def test_key_numbers_stems_flags(spark):
    assert column(spark, ["ABC-12345", "NODASH", "A-12a", "77", "A-", "A--5"], clean.numeric_suffix) == [12345, 0, 12, 77, 0, -5]
    assert column(spark, ["https://example.com/spec.html", "https://x.org/a/b/", "plain.txt", "https://x.org"], clean.url_stem) == ["spec", "https://x.org/a/b/", "plain.txt", "https://x.org"]
    assert column(spark, [",a,,b,"], clean.malformations) == [["double commas", "leading comma", "trailing comma", "mixed separators"]]
    assert column(spark, ["a &nbsp; <b>bold</b>  x@y\tz-1_2.3", None], clean.clean_text) == ["a bold x y z-1_2.3", ""]


def test_suffix_stems(spark):
    words = "running validation nation ation ring tested slowly darkness statement larger latest bed observation".split()
    want = "runn validat nat ation ring test slow dark state larg lat bed observat".split()
    assert column(spark, words, tokens.simple_stem) == want


def test_token_validity(spark):
    values = ["normal", "123456789", "!@#$%^&*()", "a" * 1000, "mixed123!@#", "", "PATIENT", "observation", "$expand", "R4", "😀😀"]
    assert column(spark, values, tokens.valid_token) == [True, False, False, False, True, False, True, True, True, True, False]


def test_token_validity_by_characters_agrees(spark):
    values = ["normal", "123456789", "!@#$%^&*()", "a" * 1000, "mixed123!@#", "", "PATIENT", "www", "$expand", "R4", "12-34", "é", "éa", "7é"]
    assert column(spark, values, tokens.valid_token_by_characters) == [True, False, False, False, True, False, True, False, True, True, True, False, True, True]


def test_stemmed_tokens_keep_order(spark):
    docs = spark.createDataFrame([(1, "Running dogs were running; the PATIENT rested"), (2, None), (3, "the of")], "id long, text string")
    got = {r.doc: r.tokens for r in tokens.stemmed_tokens(docs, "id", tokens.preprocessed(F.col("text"))).collect()}
    assert got == {1: ["run", "dog", "run", "PATIENT", "rest"], 2: [], 3: []}


def test_preprocessing(spark):
    texts = ["The Patient&nbsp;was <b>running</b> R4 codesystem at http www 123 x and the observations!", None, ""]
    assert column(spark, texts, tokens.preprocessed) == [["PATIENT", "running", "R4", "CODESYSTEM", "observations"], [], []]
    assert column(spark, ["a &lt;b&gt; foo-bar 12 it&#39;s ok"], tokens.fallback_tokens) == [["foo", "bar", "it", "ok"]]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formaliti": "formal", "electriciti": "electr", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "running": "run", "ran": "ran"}
    assert {w: tokens.porter(w) for w in pairs} == pairs


def test_stemmed_skips_exempt_terms(spark):
    rows = tokens.stemmed(spark.createDataFrame([("running",), ("PATIENT",), ("a-running",), ("running",)], "term string")).collect()
    assert sorted((r.term, r.stem) for r in rows) == [("PATIENT", "PATIENT"), ("a-running", "a-running"), ("running", "run"), ("running", "run")]


def test_dates(spark):
    got = column(spark, ["Mon, 21 Jul 2025 10:00:00 +0200", "2025-07-21T08:00:00Z", "nonsense", None], dates.feed_time)
    assert got == [dt.datetime(2025, 7, 21, 8), dt.datetime(2025, 7, 21, 8), None, None]
    assert column(spark, ["2024-01-07", "2024-01-08", "2024-12-31", "2025-01-05"], lambda c: dates.period(c.cast("timestamp"), "week")) == ["2024-01", "2024-02", "2024-53", "2025-00"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;/\\<>'.\n", max_size=30), min_size=1, max_size=20))
def test_sanitize_is_idempotent(spark, values):
    once = column(spark, values, lambda c: F.array_join(clean.sanitize_list(c, "related_pages"), ","))
    assert column(spark, once, lambda c: F.array_join(clean.sanitize_list(c, "related_pages"), ",")) == once


def test_pages_have_single_blanks_where_marks_were(spark):
    values = ["\\ < \\", "a \" ' b", "a \x80 b", "\x80 a \x7f", "< >"]
    once = column(spark, values, lambda c: clean.sanitize_list(c, "related_pages"))
    assert once == [["\\ \\"], ["a b"], ["a b"], ["a"], []]
