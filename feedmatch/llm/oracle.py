"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP5 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS newest,
         list_reduce(list_prepend('', list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::INT), 4, '0'))), lambda a, b: a || b) AS bits
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_reduce(list_prepend('', list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
           + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1))), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM g
"""

OP8 = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost || rpath DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, (len(w) - least(10, len(w)) + 2)::BIGINT),
         lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM p),
dw AS (
  SELECT doc_id, m, unnest(list_transform(range(1, (len(w) - m + 2)::BIGINT), lambda i: {'i': i, 'win': array_to_string(w[i:i + m - 1], ' ')})) AS x
  FROM d, lengths WHERE len(w) >= m
), h AS (
  SELECT DISTINCT dw.doc_id, x.i AS i, dw.m AS m, p.item_id FROM dw JOIN p ON p.win = x.win AND p.m = dw.m
), c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(i) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [a.i, b.i, e.i, g.i, h.i] AS o FROM x a, x b, x e, x g, x h WHERE len(list_distinct([a.i, b.i, e.i, g.i, h.i])) = 5
), s AS (SELECT o, list_reduce(list_transform(o, lambda i: substr('ABCDE', i, 1)), lambda p, q: p || q) AS filter_order, unnest(range(1, 6))::INT AS step FROM orders
), r AS (
  SELECT part, filter_order, step, o[step] AS f, n, good, toxic, fails,
         len(list_filter(o[:step - 1], lambda i: fails[i])) = 0 AS alive, fails[o[step]] AS hit, len(list_filter(fails, lambda b: b)) AS failed
  FROM s, c
), t AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (alive AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (NOT alive AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (alive AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (alive AND hit), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t
"""

ORACLE: dict[str, str] = {"op5_warc_chunks": OP5, "op8_bloom_cascade": OP8, "op10_wu_manber": OP10,
                          "op11_radix_audit": OP11}
