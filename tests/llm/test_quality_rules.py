import re
from collections import Counter

from corvidex.llm import quality_rules as qr
from corvidex.llm.queries import op3_host_quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if W.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_figures_match_brute_force(spark, sf, odd):
    for docs, rows in ((odd, qr.quality_rules(odd)), (spark.read.parquet(f"{sf}/documents.parquet"), op3_host_quality_rules(spark, sf))):
        want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
        got = rows.collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good = "plain words that say a little more than twenty words do when one counts them all again and then some more of it"
    rows = [(i, good, f"h{i % 10}") for i in range(400)] + [(1000 + i, "too short", "bad") for i in range(60)] + [(2000, good, "bad")] + [(3000, "too short", "tiny"), (3001, good, "tiny")]
    out = {r.doc_id: r for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[2000].kept and not out[2000].base_failed
    assert out[3001].kept and out[3001].host_rate < 0.5
    assert all(out[i].kept for i in range(400))


def test_every_rule_has_its_own_rates(spark):
    """Rates by plain sums: a host that fails only by symbols has a high rate there and nowhere else."""
    good = "plain words that say a little more than twenty words do when one counts them all again and then some more of it"
    rows = [(i, good, f"h{i % 8}") for i in range(200)] + [(300 + i, "x", "h1") for i in range(9)] + [(400 + i, (good + " ") * 3, "h2") for i in range(12)] + [(500 + i, good + " ####" * 9, "h3") for i in range(90)]
    got = {r.host: r for r in qr.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    flags = [(h, *((f := brute(t))[0] < 20, 100 * f[4] > 30 * f[0], 100 * f[2] > 10 * f[1])) for _, t, h in rows]
    for k, name in enumerate(qr.RATES):
        n, x = Counter(h for h, *_ in flags), Counter(h for h, *v in flags if (any(v) if k == 3 else v[k]))
        raw = [x[h] / n[h] for h in n]
        mean = sum(raw) / len(raw)
        a, b = qr.prior(mean, sum((v - mean) ** 2 for v in raw) / (len(raw) - 1), sum(1 / v for v in n.values()) / len(n))
        assert all(abs(got[h][name] - (x[h] + a * b) / (n[h] + b)) < 1e-9 for h in n), name
    assert [h for h in got if got[h].host_rejected] == ["h3"] and got["h3"].symbol_rate > 0.5 > got["h3"].repeat_rate


def test_empty(none):
    assert qr.quality_rules(none).count() == 0
