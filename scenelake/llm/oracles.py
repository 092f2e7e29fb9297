"""DuckDB SQL for the queries that SQL can state over whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Texts as hexadecimal, two digits a byte; windows of 100 bytes by a 64-bit hash.
OP1 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS MATERIALIZED (SELECT doc_id, base, substr(h, 2 * base + 1, 2198) AS x FROM n, unnest(range(0, n, 1000)) t(base)),
w AS MATERIALIZED (SELECT doc_id, base + i AS pos, hash(substr(x, 2 * i + 1, 200)) AS g FROM s, unnest(range(least(1000, length(x) // 2 - 99))) t(i)),
f AS (SELECT g, min((doc_id, pos)) AS first FROM w GROUP BY g HAVING count(*) > 1),
late AS MATERIALIZED (SELECT doc_id, pos FROM w JOIN f USING (g) WHERE (doc_id, pos) > first),
edge AS (SELECT *, coalesce(pos > lag(pos) OVER p + 100, true) AS new FROM late WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM edge) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER p, 0) AS a, a AS b FROM runs WINDOW p AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM n LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""

OP2 = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS n, hash(w[i:i + least(13, len(w)) - 1]) AS x FROM items, unnest(range(1, greatest(2, len(w) - 11))) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
found AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, hash(w[i:i + n - 1]) AS x FROM words, sizes, unnest(range(1, len(w) - n + 2)) t(i)) JOIN windows USING (n, x)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(n)) t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP6 = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS s FROM words, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
pairs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM words JOIN root ON a = doc_id LEFT JOIN sizes USING (doc_id)"""


def _discounts(name: str, source: str, count: str) -> str:
    n = ", ".join(f"count(*) FILTER ({count} = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
    y = "(CASE WHEN n1 + n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END)"
    d = ", ".join(
        f"least(greatest(CASE WHEN n{i} > 0 THEN {i} - {i + 1} * {y} * n{i + 1} / n{i} ELSE {i} - 0.5 END, 0.05::DOUBLE), {i} - 0.05::DOUBLE) AS d{i}" for i in (1, 2, 3)
    )
    return f"{name} AS (SELECT {d} FROM (SELECT {n} FROM {source}))"


def _followed(name: str, source: str, key: str, count: str, d: str) -> str:
    """How often a context is followed, and what the discounts take off that."""
    left = f"sum(CASE {count} WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END)"
    return f"{name} AS (SELECT {key}, sum({count}) AS total, {left} AS rest FROM {source}, {d} GROUP BY {key})"


_OFF = "greatest({c} - CASE {c} WHEN 0 THEN 0 WHEN 1 THEN {d}.d1 WHEN 2 THEN {d}.d2 ELSE {d}.d3 END, 0)"

#: crc32 of the id as text, digit by digit, then the whole model; a blank stands for the start of a text.
OP7 = rf"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT doc_id, doc_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(c >> 8, v) FROM crcs JOIN bits ON k = 8 AND n = xor(c & 255, ascii(s[i])::BIGINT) WHERE i <= length(s)),
parts AS (SELECT doc_id, xor(c, 4294967295) % 7 = 2 AS held_out FROM crcs WHERE i = length(s) + 1),
lists AS (SELECT doc_id, list_append({_WORDS}, chr(10)) AS w FROM documents),
tok AS MATERIALIZED (SELECT doc_id, held_out, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] ELSE ' ' END AS w2, CASE WHEN i > 2 THEN w[i - 2] ELSE ' ' END AS w1
  FROM lists JOIN parts USING (doc_id), unnest(range(1, len(w) + 1)) t(i)),
uni AS MATERIALIZED (SELECT w3, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w3),
tot AS (SELECT sum(c) AS n, count(*) AS v FROM uni),
tri AS MATERIALIZED (SELECT w1, w2, w3, count(*) AS c FROM tok WHERE NOT held_out GROUP BY ALL),
bi AS MATERIALIZED (SELECT w2, w3, count(*) AS c FROM tri GROUP BY ALL),
one AS MATERIALIZED (SELECT w3, count(*) AS c FROM bi GROUP BY ALL),
{_discounts("dt", "tri", "c")}, {_discounts("db", "bi", "c")}, {_discounts("du", "one", "c")},
{_followed("ft", "tri", "w1, w2", "c", "dt")}, {_followed("fb", "bi", "w2", "c", "db")},
fu AS (SELECT sum(c) AS total, sum(CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) AS rest FROM one, du),
p1 AS (SELECT tok.*, uni.c AS known, ({_OFF.format(c="coalesce(one.c, 0)", d="du")} + fu.rest / (tot.v + 1)) / fu.total AS p
  FROM tok LEFT JOIN uni USING (w3) LEFT JOIN one USING (w3), du, fu, tot),
p2 AS (SELECT p1.* REPLACE (CASE WHEN fb.total > 0 THEN ({_OFF.format(c="coalesce(bi.c, 0)", d="db")} + fb.rest * p) / fb.total ELSE p END AS p)
  FROM p1 LEFT JOIN bi USING (w2, w3) LEFT JOIN fb USING (w2), db),
p3 AS (SELECT p2.* REPLACE (CASE WHEN ft.total > 0 THEN ({_OFF.format(c="coalesce(tri.c, 0)", d="dt")} + ft.rest * p) / ft.total ELSE p END AS p)
  FROM p2 LEFT JOIN tri USING (w1, w2, w3) LEFT JOIN ft USING (w1, w2), dt)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(known)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
  sum(log10((coalesce(known, 0) + 1) / (n + v + 1)::DOUBLE)) AS base_score, sum(log10(p)) AS score, pow(10, -sum(log10(p)) / count(*)) AS perplexity
FROM p3, tot GROUP BY doc_id, held_out"""

_WS = r"\x20\x09-\x0D"

#: The same crc32, of conversations' ids; a prefix is a list of turns, each a digest and its words.
OP11 = rf"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT conv_id, conv_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, s, i + 1, xor(c >> 8, v) FROM crcs JOIN bits ON k = 8 AND n = xor(c & 255, ascii(s[i])::BIGINT) WHERE i <= length(s)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crcs WHERE i = length(s) + 1),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
marked AS (SELECT *, md5(octet_length(encode(role))::VARCHAR || ':' || role || text) AS m, len(regexp_extract_all(text, '[^{_WS}]+')) AS w FROM turns),
own AS MATERIALIZED (SELECT conv_id, list({{'m': m, 'w': w}} ORDER BY turn NULLS FIRST, role, m) AS l FROM marked GROUP BY conv_id),
built AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:]) AS l FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
paths AS MATERIALIZED (SELECT conv_id, d, l[1:d] AS p, len(l) AS n FROM built, unnest(range(len(l) + 1)) t(d)),
nodes AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
  CASE WHEN d > 0 THEN (count(*) - 1) * p[-1].w ELSE 0 END AS saved FROM paths GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
sums AS (SELECT p[1:e] AS p, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM full_nodes, unnest(range(d + 1)) t(e) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN sums USING (p, d) LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]"""

_CUT = "least(h1 % (len(u) + 1), h2 % (len(u) + 1))"
_END = "greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))"

OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[{_WS}]*[^{_WS}]+|[{_WS}]+') AS u, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, CASE WHEN t = '' OR h3 % 100 >= 50 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:{_CUT}], '') AS pre, array_to_string(u[{_CUT} + 1:{_END}], '') AS mid, array_to_string(u[{_END} + 1:], '') AS suf FROM u)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""

SQL = {"op1_suffix_array_dedup": OP1, "op2_decontaminate": OP2, "op6_minhash_dedup": OP6, "op7_ngram_lm": OP7, "op11_prefix_trie": OP11, "op13_fill_in_middle": OP13}
