"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

URL_FILTERS = r"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT k, page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM u),
r AS (
  SELECT * FROM (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
    ('net/es/', 'block'), ('net/fr/', 'block')) v(rule, rule_verdict)),
m AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM s JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY k)
SELECT s.page_id, s.host, s.path, m.rule,
  coalesce(m.rule_verdict, CASE
    WHEN regexp_matches(low, '://([a-z0-9-]+\.)*blog\..*/en/.*\?utm_source=') THEN 'allow'
    WHEN regexp_matches(low, '://([a-z0-9-]+\.)*(spam-farm|cheap-pills)\.')
      OR regexp_matches(low, '(^|[^a-z0-9])casino([^a-z0-9]|$)') OR regexp_matches(low, '(^|[^a-z0-9])utm_source=feed([^a-z0-9]|$)')
      OR regexp_matches(low, '(^|[^a-z0-9])ref=x&.*page=') OR regexp_matches(low, '(^|[^a-z0-9])page=.*&ref=x([^a-z0-9]|$)')
      OR regexp_matches(low, '://([a-z0-9-]+\.)*m\..*#top$')
      THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (k)
"""

#: Every pair of documents that shares a shingle is counted, so this suits small tables only.
NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT k, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (
  SELECT k, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS shingle
  FROM p WINDOW o AS (PARTITION BY k ORDER BY i)),
h AS (SELECT DISTINCT k, shingle FROM g WHERE i <= greatest(n - 4, 1)),
e AS (SELECT k, (SELECT count(*) FROM h WHERE h.k = d.k) AS n FROM d),
s AS (SELECT list(k) AS ks FROM h GROUP BY shingle HAVING count(*) > 1),
c AS (SELECT a, b, count(*) AS n FROM (SELECT a, unnest(ks) AS b FROM (SELECT ks, unnest(ks) AS a FROM s)) WHERE a <> b GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN e x ON x.k = c.a JOIN e y ON y.k = c.b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
r AS (SELECT k AS a, k AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, e.n AS n_shingles, (SELECT min(o.doc_id) FROM r JOIN d o ON o.k = r.b WHERE r.a = d.k) AS component_id
FROM d JOIN e USING (k)
"""

HARD_NEGATIVES = r"""
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, e.k, e.vec_id, e.label = a.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e a JOIN e ON a.k <> e.k WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, k, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS size,
    sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total
  FROM f),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * size) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * size) AS q
  FROM s),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op5_ngram_jaccard": NGRAM_JACCARD, "op6_exact_dedup": EXACT_DEDUP, "op10_url_filters": URL_FILTERS, "op12_hard_negatives": HARD_NEGATIVES, "op13_divergence_audit": DIVERGENCE}
