"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

LINE_DEDUP = """WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
  c AS (SELECT *, regexp_replace(raw, '^[ \\t\\x0b\\x0c\\r]+|[ \\t\\x0b\\x0c\\r]+$', '', 'g') AS x, NOT regexp_full_match(raw, '[ \\t\\x0b\\x0c\\r]*') AS judged FROM lines),
  d AS (SELECT x, min((doc_id, i)) AS f FROM c WHERE judged GROUP BY x),
  v AS (SELECT x, f, p, hash(left(x, p - 1) || chr(0) || substr(x, p + 1)) AS hole, hash(left(x, p - 1) || substr(x, p + 1)) AS less FROM (SELECT x, f, unnest(generate_series(1, length(x))) AS p FROM d WHERE length(x) >= 9)),
  near AS (SELECT x FROM (SELECT x, f, min(f) OVER (PARTITION BY hole) AS m FROM v) WHERE m < f
    UNION SELECT CASE WHEN v.f > d.f THEN v.x ELSE d.x END FROM v JOIN d ON v.less = hash(d.x) AND length(d.x) >= 9),
  k AS (SELECT c.*, NOT judged OR ((doc_id, i) = d.f AND n.x IS NULL) AS stays FROM c LEFT JOIN d ON d.x = c.x LEFT JOIN near n ON n.x = c.x),
  t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT stays) AS gone, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM k GROUP BY doc_id)
SELECT o.doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, sha256(t.text) AS text_sha256, t.text AS text FROM documents o LEFT JOIN t ON t.doc_id = o.doc_id"""

NGRAM_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
  n AS (SELECT doc_id, len(sh) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
  both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, c FROM r JOIN both_ways ON a = id)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""

LM_SCORING = f"""WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS a FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
  g AS (SELECT doc_id, i, a AS w1, lag(a) OVER d || ' ' || a AS w2, lag(a, 2) OVER d || ' ' || lag(a) OVER d || ' ' || a AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  c AS (SELECT *, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY w1, doc_id) AS c1, count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, doc_id) AS c2,
      count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) AS c3, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM g),
  p AS (SELECT doc_id, CASE WHEN w3 IS NOT NULL AND c3 > 0 THEN ln(c3) - ln(lag(c2) OVER d)
      WHEN w2 IS NOT NULL AND c2 > 0 THEN ln(c2) - ln(lag(c1) OVER d) + CASE WHEN w3 IS NULL THEN 0 ELSE ln(0.4) END
      ELSE ln(greatest(c1, 1)) - ln(greatest(n, 1)) + ln(0.4) * ((w2 IS NOT NULL)::INT + (w3 IS NOT NULL)::INT) END AS s FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  t AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, round(coalesce(t.s, 0), 4) AS total, round(coalesce(t.s, 0) / greatest(coalesce(t.n, 0), 1), 6) AS score FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""

EMBEDDING_DEDUP = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
  r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM r JOIN l ON a = id),
  k AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN k ON id = vec_id"""

FILTER_AUDIT = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM d LEFT JOIN marks USING (doc_id)),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o(p) AS (SELECT x FROM letters UNION ALL SELECT p || x FROM o JOIN letters ON NOT contains(p, x)),
  steps AS (SELECT p AS filter_order, k AS step, left(p, k - 1) AS gone, substr(p, k, 1) AS x FROM o CROSS JOIN generate_series(1, 5) s(k) WHERE length(p) = 5),
  c AS (SELECT part, filter_order, step, x,
      coalesce(sum(n) FILTER (translate(fails, gone || x, '') = fails), 0) AS kept, coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0) AS removed,
      coalesce(sum(n) FILTER (contains(fails, x) AND translate(fails, gone, '') <> fails), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
      coalesce(sum(good) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (contains(fails, x) AND translate(fails, gone, '') = fails), 0) AS toxic_lost
    FROM g CROSS JOIN steps GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c"""
