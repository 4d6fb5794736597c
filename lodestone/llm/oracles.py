"""DuckDB SQL of operators that need more than a few lines."""

WARC = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM p
"""

REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 199)) AS i FROM d)),
again AS (SELECT rid, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS span FROM marked),
spans AS (SELECT rid, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY rid, span),
pieces AS (
  SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM spans
  UNION ALL SELECT rid, CAST(length(h) / 2 AS BIGINT), CAST(length(h) / 2 AS BIGINT), coalesce((SELECT max(e) FROM spans x WHERE x.rid = d.rid), 0) FROM d),
kept AS (SELECT rid, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s, e) AS hex, sum(e - s) AS n_removed, count(*) - 1 AS n_spans FROM pieces JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(hex)) AS kept_sha256
FROM d JOIN kept USING (rid)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
edge AS (
  SELECT a, b FROM both_ JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE c >= 0.8 * (x.n + y.n - c)
  UNION SELECT x.rid, y.rid FROM d x JOIN d y ON x.text = y.text AND x.rid <> y.rid),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
class AS (SELECT a AS rid, min(b) AS class, count(*) AS class_rows FROM reach GROUP BY a)
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, CAST(class_rows AS BIGINT) AS class_rows FROM d JOIN class USING (rid)
"""
