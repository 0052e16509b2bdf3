"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0
), size AS (SELECT doc_id, COUNT(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 75 * (x.n + y.n - COUNT(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, MIN(r.b) AS component_id
FROM reach r LEFT JOIN size ON size.doc_id = r.a GROUP BY r.a"""

FINGERPRINTS = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50
), first AS (SELECT h, MIN(doc_id) AS d FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
one AS (SELECT doc_id, p, w[p] AS word FROM words, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (
  SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.p) AS t, COUNT(*) AS n
  FROM one ANTI JOIN gone ON gone.doc_id = one.doc_id AND gone.p = one.p GROUP BY one.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id"""

SUBSTRINGS = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, i, md5(substring(x, 2 * i + 1, 400)) AS h FROM bytes, LATERAL (SELECT unnest(range(0, n - 199)) AS i) WHERE n >= 200
), hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING COUNT(*) > 1)),
edge AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, MIN(i) AS s, MAX(i) + 200 AS e FROM run GROUP BY doc_id, r),
piece AS (
  SELECT b.doc_id, s, substring(x, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (s - coalesce(lag(e) OVER w, 0))) AS t, e
  FROM bytes b JOIN span ON span.doc_id = b.doc_id WINDOW w AS (PARTITION BY b.doc_id ORDER BY s)
), kept AS (SELECT doc_id, string_agg(t, '' ORDER BY s) AS t, MAX(e) AS e, SUM(e - s) AS gone, COUNT(*) AS runs FROM piece GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN x ELSE t || substring(x, 2 * e + 1) END)) AS kept_sha256
FROM bytes b LEFT JOIN kept ON kept.doc_id = b.doc_id"""

DECONTAMINATION = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
), met AS (
  SELECT doc_id, i, win.n, item_id FROM doc, (SELECT DISTINCT n FROM win) sizes, LATERAL (SELECT unnest(range(1, len(w) - sizes.n + 2)) AS i)
  JOIN win ON win.n = sizes.n AND win.s = array_to_string(w[i : i + sizes.n - 1], ' ') WHERE len(w) >= sizes.n
), hits AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM met) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits ON hits.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id"""

_RECORD = """encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
  || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))"""

#: Compares record by record what the audit finds by descending its trees.
FIXITY = f"""
WITH a AS (SELECT page_id, {_RECORD} AS r FROM pages),
b AS (SELECT page_id, {_RECORD} AS r FROM (SELECT page_id, url, CASE WHEN page_id % 97 = 7 THEN coalesce(html, '') || '?' ELSE html END AS html FROM pages WHERE page_id % 97 <> 13)),
pair AS (SELECT a.page_id, a.r AS x, b.r AS y FROM a LEFT JOIN b USING (page_id)),
depth AS (SELECT greatest(1, 1 + CAST(floor(ln(greatest(MAX(page_id) // 32, 1)) / ln(64) + 1e-9) AS INT)) AS d FROM pages)
SELECT page_id // 32 AS leaf, page_id, CAST(1 AS BIGINT) AS n_left, CAST(octet_length(x) AS BIGINT) AS bytes_left, CAST(CASE WHEN y IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_right,
  CAST(coalesce(octet_length(y), 0) AS BIGINT) AS bytes_right, CASE WHEN y IS NULL THEN 'missing' WHEN x = y THEN 'ok' ELSE 'altered' END AS status,
  CASE WHEN y IS NULL OR x <> y THEN (SELECT string_agg(CAST((page_id // 32) // CAST(pow(64, k) AS BIGINT) AS VARCHAR), '/' ORDER BY k DESC) FROM (SELECT unnest(range(0, d + 1)) AS k)) END AS path,
  CASE WHEN y IS NULL OR x <> y THEN CAST(coalesce(SUM(octet_length(x)) OVER (PARTITION BY page_id // 32 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS first_difference
FROM pair, depth"""
