"""DuckDB SQL of the registered queries that SQL can express; written from the
queries' contracts, not from the operators' code."""

from __future__ import annotations

from . import licenses, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, {low(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS m FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.m IS NOT NULL AND s.m <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

_MEASURED = r"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g WHERE g IS NOT NULL) WHERE c >= 2),
marks AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
        coalesce(marks.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN marks USING (r)),
q AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END)
        + (CASE WHEN len(ls) >= 4 AND 2 * (len(ls) - len(list_distinct(ls))) > len(ls) THEN 8 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND word_chars > 20 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) + (CASE WHEN 2 * n_exclaim > n_words THEN 64 ELSE 0 END) AS failed
      FROM m)
"""

QUALITY_RULES = f"""WITH {_MEASURED.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 > 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM q
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(licenses.TEMPLATES))
_PLACES = " UNION ALL ".join(
    f"SELECT r, i, '{label}' AS label FROM n WHERE " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
    for phrase, label in licenses.PHRASES)
_MARKS = ", ".join(
    f"({i}, {j}, {x.split()}, {sorted(b.decode() for b in licenses.NOT_AFTER.get(x.split()[0].encode(), ()))}::VARCHAR[])"
    for i, (_, text) in enumerate(licenses.TEMPLATES) for j, spellings in enumerate(licenses.marks_of(text)) for x in spellings)

# A block is a window of twice the template's words. A window at another start holds no more than the one at the first
# template token or mark in it, so the windows that start at one stand for all.
LICENSE_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
n AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM d),
p AS ({_PLACES}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
t(k, label, tw) AS (VALUES {_TEMPLATES}),
m(k, j, sp, barred) AS (VALUES {_MARKS}),
tok AS (SELECT k, 2 * len(tw) AS size, len(list_distinct(tw)) AS total, unnest(list_distinct(tw)) AS w FROM t),
w AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
hit AS (SELECT r, i, w, k, size, total FROM w JOIN tok USING (w)),
full_ AS (SELECT r, k FROM hit GROUP BY r, k, total HAVING count(DISTINCT w) >= {licenses.THRESHOLD} * total - 1e-9),
h AS (SELECT * FROM hit SEMI JOIN full_ USING (r, k)),
spot AS (SELECT r, k, j, i, i + len(sp) - 1 AS e FROM w JOIN m ON w.w = sp[1] JOIN d USING (r) SEMI JOIN full_ USING (r, k)
         WHERE ws[i + 1 : i + len(sp)] = sp AND NOT list_has_any(barred, ws[greatest(i - 3, 0) + 1 : i])),
s AS (SELECT r, k, i AS s FROM h UNION SELECT r, k, i FROM spot),
n_tok AS (SELECT r, k, s, size, count(DISTINCT w) / any_value(total) AS c FROM s JOIN h USING (r, k) WHERE i BETWEEN s AND s + size - 1 GROUP BY r, k, s, size),
n_mark AS (SELECT r, k, s, count(DISTINCT j) AS held FROM n_tok JOIN spot USING (r, k) WHERE i >= s AND e < s + size GROUP BY r, k, s),
x AS (SELECT r, label, max(c) AS c FROM n_tok LEFT JOIN n_mark USING (r, k, s) JOIN t USING (k)
      WHERE c >= {licenses.THRESHOLD} - 1e-9 AND coalesce(held, 0) = (SELECT count(DISTINCT j) FROM m WHERE m.k = n_tok.k) GROUP BY r, label),
names AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM x UNION SELECT r, label FROM p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(c) FROM x WHERE x.r = d.r), 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN names USING (r)
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
URL_FILTER = f"""
WITH r(v, h, p) AS (VALUES {_RULES}),
u AS (SELECT row_number() OVER () AS n, page_id, {low("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, v DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
        ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 of a number's decimal digits, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""

CONVERSATION_TRIE = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS x, length(text) AS chars FROM s),
t AS (SELECT conv_id, x, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos FROM x),
l AS (SELECT conv_id, count(*) AS len FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM l),
r AS (SELECT c.conv_id, pos AS depth, x, chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.len, 0)) + t.pos - c.h, x, chars
      FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN l b ON b.conv_id = c.base
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
p AS (SELECT *, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM q GROUP BY node),
k AS (SELECT parent AS node, count(*) AS kids FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (node)),
a AS (SELECT p.node, count(*) FILTER (m.kids = 0) AS leaves, sum((m.n_convs - 1) * m.chars) AS saved
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.node)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.kids::BIGINT AS n_children,
       a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN a USING (node) LEFT JOIN n up ON up.node = m.parent
"""

ORACLE_SQL = {"op5_line_dedup": LINE_DEDUP, "op7_quality_rules": QUALITY_RULES, "op8_license_scan": LICENSE_SCAN, "op9_url_filter": URL_FILTER,
              "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_conversation_trie": CONVERSATION_TRIE}
