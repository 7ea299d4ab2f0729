"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op1_suffix_dedup = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 49)) AS p, h FROM d WHERE len(h) >= 100),
s AS MATERIALIZED (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS x FROM w),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT s.doc_id, s.p FROM s JOIN f ON s.x = f.x WHERE f.first < s.doc_id),
e AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM r),
m AS (SELECT t.doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS fin, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substr(h, CAST(2 * fin + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN m ON m.doc_id = d.doc_id
"""

_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in ("licensed under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "click here", "subscribe to our", "javascript"))
_SEVERAL = r"regexp_matches(x, '^[ \x09-\x0D]*[^ \x09-\x0D]+([ \x09-\x0D]+[^ \x09-\x0D]+){3}')"
op2_quality_rules = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
q AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, l,
    list_filter(l, lambda x: NOT (({_PHRASES}) OR len(regexp_replace(x, '[^|>]', '', 'g')) >= 3 OR len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 20 > len(x)
      OR (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}') AND {_SEVERAL})
      OR (NOT regexp_matches(x, '[.!?:;…。！？]([ \x09-\x0D»”"'')\]]|$)') AND {_SEVERAL}))) AS good
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(coalesce(list_sum(list_transform(l, lambda x: len(x))), 0) AS BIGINT) AS chars, CAST(coalesce(list_sum(list_transform(good, lambda x: len(x))), 0) AS BIGINT) AS chars_kept FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * chars_kept >= 50 * chars AS kept, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(good) AS BIGINT) AS n_lines_removed, chars, chars_kept
FROM v
"""

op3_ngram_jaccard = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * m >= 90 * (a.n + b.n - m)),
c AS (SELECT doc_id, doc_id AS k FROM documents UNION SELECT e.v, c.k FROM c JOIN e ON e.u = c.doc_id)
SELECT c.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(c.k) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""

_WORDS4 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

op4_decontaminate = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS4} AS w FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, {_WORDS4} AS w FROM documents),
t AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT doc_id, s.k, i, item FROM s JOIN t ON t.x = s.x AND t.k = s.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

op6_line_dedup = r"""
WITH a AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS x, unnest(range(0, len(str_split(text, chr(10))))) AS line FROM documents),
l AS (SELECT doc_id, line, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM a WHERE regexp_matches(x, '[^ \x09-\x0D]')),
c AS MATERIALIZED (SELECT *, row_number() OVER o AS i, CAST(sum(n) OVER o AS BIGINT) AS upto FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
o AS MATERIALIZED (SELECT doc_id, list(x ORDER BY i) AS xs FROM c GROUP BY doc_id),
r AS (SELECT b.doc_id, b.i, e.i AS j, b.line, e.line AS stop FROM c b JOIN c e ON e.doc_id = b.doc_id AND e.i >= b.i AND e.i < b.i + 40
  WHERE e.upto - b.upto + b.n >= 40 AND (e.upto - e.n - b.upto + b.n < 40 OR e.upto - b.upto < 40)),
k AS MATERIALIZED (SELECT r.*, array_to_string(xs[r.i:r.j], chr(10)) AS x FROM r JOIN o ON o.doc_id = r.doc_id),
f AS (SELECT x, min((doc_id, i)) AS first FROM k GROUP BY x HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(line, stop + 1)) AS line FROM k JOIN f ON f.x = k.x WHERE (k.doc_id, k.i) > f.first),
n AS (SELECT doc_id, count(*) AS n, count(DISTINCT line - k) AS runs FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM g) GROUP BY doc_id),
t AS (SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.line) FILTER (WHERE g.line IS NULL) AS text FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.line = a.line GROUP BY a.doc_id)
SELECT d.doc_id, CAST(coalesce(n.runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


op10_url_filter = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE WHEN {_fits("example.org/en/1")} THEN 'example.org/en/1' WHEN {_fits("example.org/es/")} THEN 'example.org/es/' WHEN {_fits("com/fr/")} THEN 'com/fr/' WHEN {_fits("com/de/")} THEN 'com/de/' WHEN {_fits("org/")} THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN starts_with(path, '/') AND (contains(host, 'spam') OR contains(host, 'cheap-pills') OR contains(host, 'casino')) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
