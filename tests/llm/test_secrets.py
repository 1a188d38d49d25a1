import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corvidex.llm import secrets
from corvidex.llm.queries import op6_randomness_secrets

A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in A.finditer(t) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def check(docs, rows):
    want = Counter((r.doc_id, base(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, ",".join(x for x in r.spans.split(",") if not x.startswith("random"))) for r in rows)
    assert got == want
    for r in rows:
        own = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in own) for k in ("assign", "access", "hex"))


def test_base_spans(spark, sf, none, tmp_path):
    check(spark.read.parquet(f"{sf}/documents.parquet"), op6_randomness_secrets(spark, sf).collect())
    assert secrets.scan(none).count() == 0


def test_odd_rows(spark, odd, tmp_path):
    texts = ["password=token: abcdefgh", "x😀 Token : 'abc' SECRET=\"a-b_c.d=e\" api_key='é' apikey:: zzzzzzz", "AKIAAKIA" + "B" * 12 + " AKIA1", "f" * 24 + "g" + "0" * 23, "passwd='" + "q" * 9 + "' " * 3]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(docs, op6_randomness_secrets(spark, str(tmp_path)).collect())


ENCODINGS = {
    "digits": string.digits, "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase, "BASE36": string.digits + string.ascii_uppercase, "letters": string.ascii_letters, "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_", "uuid": "0123456789abcdef",
}


def key(r, encoding, n):
    x = "".join(r.choices(ENCODINGS[encoding], k=n))
    return x if encoding != "uuid" else "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))


def ordinary(r, words, n):
    """A run of joined words, an identifier, a path, a dated name or a structured number of ``n`` characters at least."""
    out = r.choices(words, k=12)
    kind = r.randrange(9)
    made = (
        "".join(out).lower(), "".join(out).upper(), "".join(w.capitalize() for w in out), "_".join(out).lower(), "-".join(out).lower(), "/".join(out).lower(),
        "".join(w.capitalize() if r.random() < 0.6 else w.lower() for w in out), f"{out[0].lower()}-{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-" + "-".join(out[1:]).lower(),
        f"{r.randint(2000, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}" + "0" * r.randint(3, 9) + f"{r.randint(0, 9999)}" + "0" * 30,
    )[kind]
    return made[:n].rstrip("_-/").ljust(n, "e")


@pytest.fixture(scope="module")
def words(sf):
    con = duckdb.connect()
    return [w for (t,) in con.execute(f"SELECT text FROM '{sf}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 300").fetchall() for w in re.findall("[A-Za-z]{3,}", t)]


def verdicts(spark, runs):
    """How many of each kind of (kind, run) are found: of ordinary runs (None) those the battery adds, of others also base spans."""
    docs = spark.createDataFrame([(i, f"some text {x} and more") for i, (_, x) in enumerate(runs)], "doc_id long, text string")
    got = {x.doc_id: len(x.random) + (len(x.hex) if runs[x.doc_id][0] else 0) for x in secrets.scan(docs).collect()}
    return docs, got, Counter(runs[i][0] for i, n in got.items() if n)


def test_recall_and_false_discoveries(spark, words):
    """Keys of 32 characters of every encoding among as many ordinary runs, and rarer ones of 24 and 40."""
    r = random.Random(3)
    runs = [(e, key(r, e, 32)) for e in ENCODINGS for _ in range(100)] + [(None, ordinary(r, words, 32)) for _ in range(1200)]
    _, _, hits = verdicts(spark, runs)
    false = hits.pop(None, 0)
    assert false <= 0.03 * hits.total(), false
    assert {e: hits[e] for e in ENCODINGS if hits[e] < 90} == {}
    for n, least in ((24, 0.6), (40, 0.8)):
        runs = [(e, key(r, e, n)) for e in ENCODINGS if e != "uuid" for _ in range(20)] + [(None, ordinary(r, words, n)) for _ in range(1500)]
        _, _, hits = verdicts(spark, runs)
        false = hits.pop(None, 0)
        assert false <= 0.05 * hits.total() and hits.total() >= least * 20 * 11, (n, false, hits)


def test_words_and_sequences_are_spared(spark):
    r = random.Random(3)
    keys = [key(r, "base64", r.choice((32, 40, 44, 64))) for _ in range(60)]
    spared = ["thaterndingha", "internationalization", "snake_case_identifier_of_some_length", "src/main/java/org/example/Widget", "entekeitschpfkeitberlich", "a" * 24, string.ascii_lowercase, string.ascii_uppercase]
    spared += ["AbstractSingletonProxyFactoryBean", "00000000000000000000000001", "the-quick-brown-fox-jumps-over", "0123456789" * 3, "-" * 30, "_" * 19 + "a", string.digits + string.ascii_uppercase]
    rows = [(True, x) for x in keys] + [(None, x) for x in spared]
    _, _, hits = verdicts(spark, rows)
    assert hits[True] >= 55 and hits[None] == 0


def test_short_random_keys_are_found_among_as_many_ordinary_runs(spark, words):
    """Benjamini-Hochberg alone decides: no floor below which a step is refused."""
    r = random.Random(11)
    least = {("base62", 20): 0.8, ("base36", 20): 0.7, ("letters", 20): 0.5, ("HEX", 20): 0.6, ("base62", 32): 0.95, ("base36", 32): 0.9, ("HEX", 32): 0.9, ("base32", 32): 0.85}
    runs = [((e, n), key(r, e, n)) for e, n in least for _ in range(100)] + [(None, ordinary(r, words, n)) for _, n in least for _ in range(100)]
    docs, got, hits = verdicts(spark, runs)
    assert set(got.values()) <= {0, 1}
    assert hits.pop(None, 0) <= 0.03 * hits.total()
    for k, share in least.items():
        assert hits[k] >= 100 * share, (k, hits[k])
    clean = {x.doc_id: x.text for x in secrets.redacted(docs.withColumn("n_chars", F.length("text"))).collect()}
    assert all(("[SECRET]" in clean[i]) == bool(n) for i, n in got.items() if runs[i][0])


def step_of(run):
    """The battery by plain loops."""
    core = re.sub("[^A-Za-z0-9]", "", run)
    n = len(core)
    if n < secrets.MIN_CORE:
        return 0, ""
    name, _, size, excess, change = next(a for a in secrets.ALPHABETS if a is secrets.ALPHABETS[-1] or re.fullmatch(a[1] + "+", core))
    chi = size / n * sum(v * v for v in Counter(core).values()) - n
    if name in ("lower", "upper"):
        kinds = [c in "aeiouAEIOU" for c in core]
    elif name == "digits":
        kinds = [c < "5" for c in core]
    else:
        kinds = ["d" if c.isdigit() else "U" if c.isupper() else "l" for c in core]
    more = (sum(x != y for x, y in zip(kinds, kinds[1:])) - (n - 1) * change) / ((n - 1) * change * (1 - change)) ** 0.5
    at = [(string.digits + string.ascii_uppercase + string.ascii_lowercase).index(c) for c in core]
    mean = sum(at) / n
    var = sum((x - mean) ** 2 for x in at)
    r = min(abs(sum((x - mean) * (y - mean) for x, y in zip(at, at[1:])) / var if var else 1.0), 0.999)
    z = ((size - 1) + (n - 1) * excess - chi) / (2 * (size - 1) + 4 * (n - 1) * excess) ** 0.5
    z = (z + (-more if name in ("lower", "upper") else more) + min(0, 2 - math.atanh(r) * (n - 3) ** 0.5)) / 1.5
    return (min(secrets.STEPS, math.floor((0.717 * z + 0.416 * z * z + 0.693) * 10 / math.log(10))) if z > 0 else 0), name


def test_battery_against_plain_loops(spark, words):
    r = random.Random(9)
    runs = [key(r, e, n) for e in ENCODINGS for n in (20, 33, 64, 500) for _ in range(4)] + [ordinary(r, words, r.randint(20, 80)) for _ in range(200)] + ["a" * 30, "-" * 25, "ab" * 20, "A1-" * 9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(runs)], "i int, x string").select("i", secrets.battery(F.col("x")).alias("t"))
    off = [(runs[row.i], (row.t.step, row.t.encoding), step_of(runs[row.i])) for row in df.collect() if abs(row.t.step - step_of(runs[row.i])[0]) > 1 or row.t.encoding != step_of(runs[row.i])[1]]
    assert off == []


def test_long_runs_and_many_matches_end_soon(spark):
    """A run of a million characters, and twenty thousand matches in one text, in seconds."""
    r = random.Random(4)
    rows = [(1, "x " + "".join(r.choices(ENCODINGS["base64"], k=1_000_000)) + " y"), (2, " ".join(key(r, "base36", 24) for _ in range(20_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: x for x in secrets.scan(docs).collect()}
    assert [tuple(x) for x in got[1].random] == [(2, 1_000_002)]
    found = sorted(tuple(x) for k in ("random", "hex") for x in got[2][k])
    assert len(found) > 15_000 and all(e - s <= 24 for s, e in found)
    assert time.time() - began < 90


def test_redaction(spark, odd, none):
    docs = spark.createDataFrame([(1, "my password=abcdef123 and AKIA" + "Z" * 16 + " 😀 end", "en", "s", 40), (2, "clean", "en", "s", 5), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert out[1].text == "my [SECRET] and [SECRET] 😀 end" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[3].text is None
    assert secrets.redacted(odd).columns == odd.columns and secrets.redacted(odd).count() == odd.count()
    assert secrets.redacted(none).count() == 0


def test_own_names_of_the_input_stay(spark):
    names = ["found", "spots", "clean", "_found", "_s", "_p", "_t", "_end", "cand", "Random"]
    docs = spark.createDataFrame([(1, "password=abcdef123", *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    row = secrets.redacted(docs).first()
    assert row.text == "[SECRET]" and list(row[2:]) == names
    assert secrets.scan(docs).count() == 1


def test_redaction_follows_all_spans(spark, sf, odd):
    """Every span of the scan, base and added, becomes one mark; what lies between stays, whatever overlaps."""
    r = random.Random(8)
    more = [(2 * 10**9 + i, f"see {key(r, 'base64', 40)} é token={key(r, 'base62', 30)} 😀 {key(r, 'uuid', 32)} AKIA{'Q' * 20}", "en", "s", None) for i in range(40)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 10**10, "text", "lang", "source", "n_chars").toDF(*docs.columns))
    found = {x.doc_id: sorted((a.s, a.e) for k in secrets.KINDS for a in x[k]) for x in secrets.scan(docs).collect()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert sum(len(v) for v in found.values()) > 100
    for x in secrets.redacted(docs).collect():
        at, out = 0, ""
        for s, e in found[x.doc_id]:
            if s >= at:
                out += texts[x.doc_id][at:s] + "[SECRET]"
            at = max(at, e)
        want = None if texts[x.doc_id] is None else out + texts[x.doc_id][at:]
        assert x.text == want and (not found[x.doc_id] or x.n_chars == len(want))
