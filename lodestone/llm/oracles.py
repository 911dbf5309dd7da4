"""DuckDB SQL for the operators that SQL can express over the whole table at the size of the correctness check."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD3 = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, host, md5(t) AS digest, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
lw AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
often AS (SELECT host, norm FROM lw GROUP BY 1, 2 HAVING count(DISTINCT digest) > 20),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS gone FROM lw JOIN often USING (host, norm) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM lw GROUP BY 1),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_line_words
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_line_words,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * (n_words - n_line_words) < 30 * n_words) AS kept FROM s"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {WORD3.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORD3.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
x AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS k, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

TERMS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

DIVERGENCE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, {TERMS.format("text")} AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (t.total + v) AS p FROM t JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (total + v) AS q FROM kept JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT lang, source, 'pair' AS part, item, value FROM allpairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM x
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 200"""


#: crc32 as in zlib: the table of remainders by its rule, then one step for each UTF-8 byte of a distinct feature.
RESAMPLING = rf"""
WITH tab AS (SELECT list(r ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS r FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, row_number() OVER () AS r, {WORD3.format("text")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, {WORD3.format("text")} AS w FROM benchmark),
df AS (SELECT r, w[k] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) UNION ALL SELECT r, w[k] || ' ' || w[k + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS k FROM d)),
bf AS (SELECT w[k] AS x FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM i) UNION ALL SELECT w[k] || ' ' || w[k + 1] FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i)),
h AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM df UNION SELECT x FROM bf)),
b AS (SELECT x, list_transform(range(1, length(h) // 2 + 1), lambda k: CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT)) AS b FROM h),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295, b), lambda s, y: xor(s // 256, tab[xor(s % 256, y) + 1])), 4294967295) % 10000 AS bucket FROM b, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN c USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN c USING (x) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM df) AS ns, (SELECT count(*) FROM bf) AS nt),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ns + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(nt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN c USING (x) JOIN g USING (bucket) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS weight, CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM f),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM k) THEN rank END AS rank FROM z LEFT JOIN k USING (doc_id)"""


ORACLE: dict[str, str] = {"op2_quality_rules": QUALITY, "op3_decontamination": DECONTAMINATION, "op4_near_dedup": NEAR_DEDUP, "op9_substring_dedup": SUBSTRINGS, "op12_source_divergence": DIVERGENCE, "op13_importance_resampling": RESAMPLING}
