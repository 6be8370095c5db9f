"""DuckDB SQL for the corpus queries that SQL can express; doc_id is taken as unique."""

from __future__ import annotations

import re

from .chat_format import CONTROL, MARKS
from .embedding_dedup import COSINE
from .minhash import SHINGLE, SIMILARITY


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD = _quoted(r"[^ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*")
_TOKEN = _quoted(r"[ \t\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\x0b\f\r]*|[ \t\x0b\f\r]*\n[ \t\n\x0b\f\r]*|[ \t\x0b\f\r]+")

LINE_WINDOWS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws, regexp_extract_all(coalesce(text, ''), {_TOKEN}) AS ts FROM documents),
c AS (SELECT doc_id, ws, ts, list_filter(range(1, len(ws) + 1), lambda i: i = len(ws) OR starts_with(ws[i], chr(10)) OR (i > 2 AND i + 4 <= len(ws) AND NOT starts_with(ws[i + 1], chr(10)) AND ws[i + 1] < ws[i] AND ws[i + 1] < ws[i - 1] AND ws[i + 1] < ws[i - 2]
  AND ws[i + 1] <= ws[i + 2] AND ws[i + 1] <= ws[i + 3] AND ws[i + 1] <= ws[i + 4])) AS es FROM w),
b AS (SELECT *, list_transform(es, lambda e, j: CASE WHEN j = 1 THEN 1 ELSE es[j - 1] + 1 END) AS bs FROM c),
t AS (SELECT doc_id, list_transform(es, lambda e, j: array_to_string(ts[bs[j]:e], '')) AS ls,
  list_transform(es, lambda e, j: array_to_string(ws[bs[j]:e - CASE WHEN starts_with(ws[e], chr(10)) THEN 1 ELSE 0 END], ' ')) AS tr FROM b),
p AS (SELECT doc_id, pos, tr[pos + 1] AS a, tr[pos + 2] AS b, tr[pos + 3] AS c FROM (SELECT doc_id, tr, unnest(range(0, len(tr) - 2)) AS pos FROM t)),
f AS (SELECT a, b, c, min(doc_id) AS d0 FROM p GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(pos, min(pos) OVER (PARTITION BY doc_id, a, b, c) + 3) ELSE pos END AS s, pos + 2 AS e FROM p JOIN f USING (a, b, c)),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s, e + 1)))) AS gone FROM m WHERE s <= e GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), '') END AS text,
  CAST(len(ls) AS INTEGER) AS n_lines, CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed
FROM documents d JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)"""


_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
#: The patterns written out again (kind, pattern, group of the value, least characters), so that a slip in the operator's shows.
_RULES = [
    ("assign", f"({_NAMES})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("owned", "[A-Za-z0-9+/_-]+", 0, 20),
]


def _spans() -> str:
    parts = []
    for k, (kind, pattern, group, least) in enumerate(_RULES):
        p = _quoted(pattern)
        found = f"SELECT doc_id, source, lang, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS b FROM c WHERE regexp_matches(t, {p})"
        start = "CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        parts.append(f"SELECT doc_id, source, lang, {k} AS k, '{kind}' AS kind, {start} AS s, {start} + length(m[i]) AS e, v[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({found})) WHERE length(v[i]) >= {least}")
    return "\n UNION ALL ".join(parts)


SECRETS = f"""
WITH c AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
x AS ({_spans()}),
base AS (SELECT * FROM x WHERE k < 3),
other AS (SELECT * FROM x WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = x.doc_id AND x.s < base.e AND base.s < x.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM other),
o AS (SELECT v, count(DISTINCT source) AS o, count(DISTINCT source || chr(1) || lang) AS r FROM every GROUP BY v),
owners AS (SELECT *, CASE WHEN o >= 3 OR r >= 5 THEN 'example' WHEN o = 1 THEN 'live' ELSE 'shared' END AS class FROM o),
y AS (SELECT * FROM every JOIN owners USING (v)),
r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3 OR class = 'live'), '') AS spans,
  coalesce(string_agg(o || ':' || r, ',' ORDER BY s, k) FILTER (k < 3 OR class = 'live'), '') AS spread,
  count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'shared') AS n_shared, count(*) FILTER (class = 'example') AS n_example FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(spread, '') AS spread,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example FROM c LEFT JOIN r USING (doc_id)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n ON u = vec_id GROUP BY vec_id"""

_ESCAPES = _quoted(r"(\\|" + "|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)).replace(r"\ ", " ").replace(r"\#", "#") + ")")
_SHOWN = "length(regexp_replace({0}, " + _ESCAPES + r", '\\\1', 'g'))"

CONVERSATIONS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, MARKS))} + {_SHOWN.format("role")} + {_SHOWN.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_WORDS = r"list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
k AS (SELECT *, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE chr(0) || text END AS key FROM d),
c AS (SELECT key, min(doc_id) AS node, any_value(w) AS w, count(*) AS copies FROM k WHERE trim(coalesce(text, '')) <> '' GROUP BY key),
g AS (SELECT node, g, count(*) AS c FROM (SELECT node, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) AS g FROM c WHERE len(w) > 0) GROUP BY ALL),
s AS (SELECT node, sum(c) AS s FROM g GROUP BY node),
h AS (SELECT a.node AS u, b.node AS v, sum(least(a.c, b.c)) AS h FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
l AS (SELECT u, v FROM h JOIN s a ON a.node = u JOIN s b ON b.node = v WHERE h >= {SIMILARITY} * (a.s + b.s - h)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT node, node AS c FROM c UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node),
m AS (SELECT node, min(c) AS class_id FROM r GROUP BY node),
z AS (SELECT class_id, sum(copies) AS n FROM m JOIN c USING (node) GROUP BY class_id)
SELECT k.doc_id, coalesce(m.class_id, k.doc_id) AS class_id, CAST(coalesce(z.n, 1) AS BIGINT) AS n_class, coalesce(m.class_id, k.doc_id) = k.doc_id AS kept
FROM k LEFT JOIN c USING (key) LEFT JOIN m USING (node) LEFT JOIN z ON z.class_id = m.class_id"""


def _parts(url: str) -> str:
    """host, path and address of an expression, as columns."""
    rest = f"CASE WHEN contains({url}, '://') THEN {url}[instr({url}, '://') + 3:] ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce({host}, '') AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, {host} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) AS address"


_RULE = """CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END"""
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_CANONICAL = r"""(?i)\srel\s*=\s*["']?([^"'>]*\s)?canonical[\s"'/>]"""
_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh[\s"'/>]"""
_TAGS = f"list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\\s[^>]*>'), lambda t: regexp_matches(t, {_quoted(_CANONICAL)}))"
_METAS = f"list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\s[^>]*>'), lambda t: regexp_matches(t, {_quoted(_REFRESH)}))"
_CONTENT = r"""(?i)\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""

URLS = f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_parts("url")} FROM pages),
l AS (SELECT host, path, address, unnest(list_transform({_TAGS}, lambda t: regexp_extract(t, {_quoted("(?i)" + chr(92) + "shref" + _VALUE)}, 1)) || list_transform({_METAS}, lambda t: regexp_extract(t, {_quoted(_CONTENT)}, 1))) AS link FROM p),
t AS (SELECT host, path, address, trim(replace(regexp_replace(link, {_quoted("^[" + chr(34) + "']|[" + chr(34) + "']$")}, '', 'g'), '&amp;', '&')) AS link FROM l),
a AS (SELECT address AS u, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN 'x:' || link WHEN link LIKE '/%' THEN 'x://' || host || link
  WHEN link LIKE '?%' THEN 'x://' || host || path || link WHEN regexp_matches(link, '^(#|$)|^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  ELSE 'x://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^.*/') ELSE '/' END || link END AS url FROM t WHERE host <> ''),
e AS (SELECT u, address AS v, {_RULE} AS rule FROM (SELECT u, {_parts("url")} FROM a) WHERE host <> ''),
b AS (SELECT address AS x FROM p WHERE {_RULE} IN ('net/', 'example.com/de/') UNION SELECT v FROM e WHERE rule IN ('net/', 'example.com/de/')),
two AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT x FROM b UNION SELECT v FROM r JOIN two ON u = x)
SELECT page_id, host, path, {_RULE} AS rule, CASE WHEN {_RULE} IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN {_RULE} IS NOT NULL OR r.x IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  {_RULE} IS NULL AND r.x IS NOT NULL AS aliased FROM p LEFT JOIN r ON r.x = address AND host <> ''"""

#: CRC-32 as a fold over the bytes, each followed by eight shifts (-1).
_BYTES = "flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(x) - 64] END || [-1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

SPELLING = f"""
WITH RECURSIVE t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT d, run, count(*) AS c, d || ':' || run AS s FROM t WHERE length(run) >= 5 GROUP BY ALL), h AS (SELECT run, c, {_CRC} AS h FROM u),
x AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
k AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest, i = 1 OR word[i] <> word[i - 1] AS first FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION ALL SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = rest WHERE first UNION ALL SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = rest WHERE first),
g AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, word AS tip, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = tip WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(tip, steps) AS root FROM r GROUP BY word) USING (word)"""


def _terms(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w"


SEARCH = f"""
WITH tok AS (SELECT doc_id, {_terms("text")} FROM documents), q AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, {_terms("text")} FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), k AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
tf AS (SELECT doc_id, w, count(*) AS tf FROM tok WHERE w IN (SELECT w FROM q) GROUP BY ALL),
weight AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, k GROUP BY w, n_docs),
p AS (SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS s FROM tf JOIN n USING (doc_id) JOIN weight USING (w), k),
s AS (SELECT item_id, doc_id, CAST(sum(c * s) AS BIGINT) AS score FROM q JOIN p USING (w) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

_UTF8 = """CASE WHEN unicode(x) < 128 THEN [unicode(x)] WHEN unicode(x) < 2048 THEN [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]
  WHEN unicode(x) < 65536 THEN [224 + (unicode(x) >> 12), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)] ELSE [240 + (unicode(x) >> 18), 128 + ((unicode(x) >> 12) & 63), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)] END"""
_TEXT_CRC = f"xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(flatten(list_transform(string_split(t, ''), lambda x: {_UTF8})), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

#: Rows are numbered in order of doc_id, which is the order of the file.
SHARDS = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
j AS (SELECT doc_id, shards, CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE CAST(doc_id AS HUGEINT) END AS k, -1::BIGINT AS last, 0::BIGINT AS next FROM d, (VALUES (8), (9)) s(shards)
  UNION ALL SELECT doc_id, shards, h, next, CAST(floor((next + 1) * (2147483648::DOUBLE / CAST(h // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS h FROM j WHERE next < shards)),
p AS (SELECT doc_id, CAST(max(last) FILTER (shards = 8 AND next >= 8) AS INTEGER) AS shard, CAST(max(last) FILTER (shards = 9 AND next >= 9) AS INTEGER) AS grown_shard FROM j GROUP BY doc_id)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0::BIGINT ELSE {_TEXT_CRC} END AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM d JOIN p USING (doc_id)"""
