"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, word: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({text}, {chr(39)}{chr(39)})')}, '{word}')"


_OP1 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP5 = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text', _OP1)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', _OP1)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, n.n, unnest(range(1, CAST(len(w) - n.n + 2 AS BIGINT))) AS i, w FROM d, n WHERE len(w) >= n.n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON list_slice(dw.w, dw.i, dw.i + dw.n - 1) = bw.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _OP5)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT r.v AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.v GROUP BY r.v"""

# SHA-1 in base 32: the digest's 160 bits in fives
OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0')), '') AS bits FROM q)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, j * 5 + k + 1, 1) AS BIGINT) * CAST(power(2, 4 - k) AS BIGINT))) AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

# crc32 of a conversation's id, bit by bit; a node is its depth and smallest member
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY i) AS l FROM t GROUP BY conv_id),
c AS (SELECT conv_id, l, {_CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM own),
s AS (SELECT c.conv_id, coalesce(list_slice(b.l, 1, h), []) || list_slice(c.l, h + 1, len(c.l)) AS l FROM c LEFT JOIN own b ON b.conv_id = c.base),
p AS (SELECT conv_id, d, list_slice(l, 1, d) AS pre, len(l) = d AS ends FROM s, unnest(range(0, len(l) + 1)) AS u(d)),
m AS (SELECT conv_id, d, min(conv_id) OVER (PARTITION BY d, pre) AS rep, ends, CASE WHEN d > 0 THEN strlen(pre[d].t) ELSE 0 END AS b FROM p),
n AS (SELECT d, rep, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM m GROUP BY d, rep),
up AS (SELECT n.d, n.rep, m.rep AS parent FROM n LEFT JOIN m ON m.conv_id = n.rep AND m.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS rep, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN kids USING (d, rep)),
sub AS (SELECT m.d, m.rep, sum(v.saved) AS saved_tokens, count(*) FILTER (WHERE v.k = 0) AS n_leaves FROM v JOIN m ON m.conv_id = v.rep AND m.d <= v.d GROUP BY ALL)
SELECT v.rep AS conv_id, v.d AS depth, up.parent AS parent_conv_id, n_convs, k AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN up USING (d, rep) JOIN sub USING (d, rep)"""

ORACLE_SQL = {"op1_suffix_arrays": OP1, "op5_jaccard_join": OP5, "op7_warc": OP7, "op12_prefix_trie": OP12}
