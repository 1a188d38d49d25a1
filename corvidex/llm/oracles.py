"""DuckDB SQL for the queries of this subpackage that SQL can express.

Not among them: learned scores (op1, op2, op9: held-out accuracy or a brute-force
model), tokenising (op4, op8: exact round trips), 64-bit string hashes of fingerprints
(op5) and the randomness tests (op6: brute force).
"""

WORD = r"[^\x20\x09-\x0D]+"
ODD = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"

HOST_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
f AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ln USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, 100 * n_symbols > 10 * word_chars AS junk FROM f),
u AS (SELECT source, unnest([{{k: 'short', x: n_words < 20}}, {{k: 'repeat', x: 100 * n_repeat_words > 30 * n_words}}, {{k: 'symbol', x: junk}}, {{k: 'host', x: base_failed OR junk}}]) AS e FROM b),
h AS (SELECT source, e.k AS rule, count(*) AS n, count(*) FILTER (e.x) AS x FROM u GROUP BY ALL),
m AS (SELECT rule, avg(x / n) AS mean, coalesce(var_samp(x / n), 0) AS var, avg(1 / n) AS inv FROM h GROUP BY rule),
e AS (SELECT rule, mean, greatest(var - mean * (1 - mean) * inv, 0) AS extra FROM m),
s AS (SELECT rule, mean, least(greatest(CASE WHEN extra > 0 AND mean > 0 AND mean < 1 THEN mean * (1 - mean) / extra - 1 ELSE 20 END, 1), 10000) AS k FROM e),
r AS (SELECT source, max((x + mean * k) / (n + k)) AS worst, any_value((x + mean * k) / (n + k)) FILTER (rule = 'short') AS short_rate, any_value((x + mean * k) / (n + k)) FILTER (rule = 'repeat') AS repeat_rate,
  any_value((x + mean * k) / (n + k)) FILTER (rule = 'symbol') AS symbol_rate, any_value((x + mean * k) / (n + k)) FILTER (rule = 'host') AS host_rate FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT junk AND worst <= 0.5 AS kept,
  round(short_rate, 9) AS short_rate, round(repeat_rate, 9) AS repeat_rate, round(symbol_rate, 9) AS symbol_rate, round(host_rate, 9) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source AS src, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, src, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS size,
    pow((('0x' || md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(t)))[1:13])::BIGINT + 0.5) / 4503599627370496.0,
      1 / (CASE WHEN length(t) = 0 THEN 0.5 ELSE 1.5 - (length(t) - length(regexp_replace(t, '{ODD}', '', 'g'))) / length(t) END)) AS key
  FROM d),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM k GROUP BY src),
w AS (SELECT src, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, 2 * source_size / w AS full_at, sum(2 * source_size) OVER u AS filled, sum(w) OVER u AS used FROM w WINDOW u AS (ORDER BY 2 * source_size / w, src NULLS LAST)),
lv AS (
  SELECT 0 AS filled, 0.0::DOUBLE AS used UNION ALL SELECT filled, used FROM o),
best AS (SELECT max(level) AS level FROM (
  SELECT (1.5 * (SELECT sum(source_size) FROM s) - filled) / ((SELECT sum(w) FROM w) - used) AS level, filled FROM lv WHERE used < (SELECT sum(w) FROM w)) x
  WHERE filled = (SELECT coalesce(sum(2 * source_size), 0) FROM w WHERE 2 * source_size / w <= x.level)),
g AS (SELECT src, source_size, CASE WHEN level * w >= 2 * source_size THEN 2.0 * source_size ELSE level * w END::DOUBLE AS target FROM w, best),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
c AS (SELECT *, CASE WHEN epochs >= 2 THEN 0 ELSE floor(target) - epochs * source_size END::BIGINT AS rest FROM b),
r AS (SELECT k.*, source_size, target, epochs, rest, sum(size) OVER (PARTITION BY k.src ORDER BY key DESC, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM k JOIN c ON k.src IS NOT DISTINCT FROM c.src)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""

ORACLES = {"op3_host_quality_rules": HOST_RULES, "op7_partenum_jaccard": JACCARD, "op10_source_mix": MIX}
