"""The SQL that states what an operator returns, where SQL can."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[^\x20\x09-\x0D]+"

#: Windows of 100 bytes, two hexadecimal digits a byte; ids are unique in the driver's tables.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS s, h FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 200)) AS k FROM w),
f AS (SELECT doc_id, s, (doc_id, s) > min((doc_id, s)) OVER (PARTITION BY k) AS again FROM k),
n AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS new FROM f WHERE again),
r AS (SELECT doc_id, s, sum(CASE WHEN coalesce(new, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM n),
i AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM i),
t AS (SELECT p.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS z, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN t.z IS NULL THEN h ELSE kept || substring(h, 2 * t.z + 1) END)) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""

CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all({LOWER}, '{ALNUM}') AS w FROM benchmark),
bi AS (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) s WHERE len(w) >= s.n),
hit AS (SELECT r, i, di.n, id FROM di JOIN win ON win.n = di.n AND win.k = array_to_string(w[i:i + di.n - 1], ' ')),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hit) GROUP BY r),
word AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN item USING (r) LEFT JOIN word USING (r)"""

#: All pairs that share a shingle, and the smallest id reachable over links; ids are unique in the driver's tables.
NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACE}') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n_both >= 80 * (x.n + y.n - p.n_both)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id"""
