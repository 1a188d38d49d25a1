import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("f", T.StringType()),
    ]
)


def odd_rows():
    r = random.Random(7)
    words = ["alpha", "beta", "Gamma", "déjà", "vu,", "x", "42", "end."]
    texts = [" ".join(r.choices(words, k=n)) for n in (1, 5, 19, 20, 21, 60, 200, 700)]
    texts += [None, "", " ", "\n\n", " \x1c words\x1d here", "😀 " * 40, "one line\n" * 30, "z" * 5000, " ".join(r.choices(words, k=30000))]
    texts += [texts[6], texts[6], texts[6] + " tail", "a1" * 40 + " password = 'Zx9+q/7Lm2Pq'", "the token: abc AKIA" + "Q" * 18]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"s{i % 4}", None if t is None else len(t), "x", None, "k", "f") for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "no id at all " * 12, None, None, None, None, None, None, None))
    rows.append((10**12, "far id " * 30, "en", "s0", 7, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
