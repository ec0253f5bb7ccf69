"""What the operators that SQL can express return, as SQL for DuckDB."""

from __future__ import annotations

#: Sets of shingles joined on equal shingles, pairs counted and held against the bound, least id by reachability.
JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT both_.b, r.root FROM r JOIN both_ ON both_.a = r.doc_id WHERE r.root < both_.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""

#: Every 100-byte string of every text numbered in order of (doc_id, start); runs covered by all but the first go.
SUFFIXES = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
b AS (SELECT doc_id, x, octet_length(x) AS n FROM t),
at_ AS (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM b),
u AS (SELECT doc_id, i, x[i : i + 99] AS s FROM at_),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM u),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM f WHERE k > 1),
h AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM h GROUP BY doc_id, span),
m AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
cuts AS (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, n + 1, n + 1 FROM b),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_, a - 1 AS to_ FROM cuts),
kept AS (SELECT gaps.doc_id, string_agg(hex(b.x[from_ : to_]), '' ORDER BY from_) AS h FROM gaps JOIN b ON b.doc_id = gaps.doc_id WHERE to_ >= from_ GROUP BY gaps.doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(m.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256 FROM b LEFT JOIN m ON m.doc_id = b.doc_id LEFT JOIN kept ON kept.doc_id = b.doc_id"""

#: Five conditions by text, documents joined with each order's filters, and counts by part, order and step.
AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT d.doc_id, d.part, d.text, c.least, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS l FROM d JOIN c ON c.text = d.text),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, concat(
 CASE WHEN len(w.l) < 200 THEN 'A' ELSE '' END,
 CASE WHEN 100 * len(list_distinct(w.l)) < 50 * len(w.l) THEN 'B' ELSE '' END,
 CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END,
 CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END,
 CASE WHEN w.least < w.doc_id THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.k, b.k, c.k, d.k, e.k) AS filter_order FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i : i] AS own, filter_order[1 : i - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS i)),
t AS (SELECT m.*, s.filter_order, s.step, s.own, contains(m.fails, s.own) AS hit, translate(m.fails, s.before, '') <> m.fails AS gone FROM m CROSS JOIN s),
r AS (SELECT part, filter_order, step, own,
 CAST(sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS BIGINT) AS kept,
 CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
 CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
 CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
 FROM t GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
