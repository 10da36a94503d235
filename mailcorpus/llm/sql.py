"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {}

ORACLE_SQL["op5_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
l AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (min(p.n) + min(q.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, g.doc_id = c.component_id AS kept
FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON g.doc_id = c.a
"""

ORACLE_SQL["op10_substring"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS x FROM s),
d AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h JOIN d USING (x)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: ps IS NULL OR NOT list_contains(ps, z[2])), lambda z: z[1]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

ORACLE_SQL["op8_chat"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(x) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op6_decontaminate"] = f"""
WITH b AS (SELECT item_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
d AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
bp AS (SELECT item_id, len(ws) AS size, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM b)),
bg AS (SELECT item_id, size, g, count(*) AS c FROM bp GROUP BY ALL),
dg AS MATERIALIZED (SELECT doc_id, len(ws) AS n, i AS pos, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM d)),
p AS (SELECT doc_id, item_id, size, n, min(pos) AS lo, max(pos) AS hi FROM dg JOIN bg USING (g) GROUP BY ALL HAVING 9 * count(*) >= 8 * (size - 4)),
s AS (SELECT doc_id, item_id, size, unnest(range(greatest(1, lo - size + 5), least(n - size + 1, hi) + 1)) AS s FROM p),
w AS (SELECT s.doc_id, item_id, size, s, g, count(*) AS c FROM s JOIN dg ON dg.doc_id = s.doc_id AND pos BETWEEN s AND s + size - 5 GROUP BY ALL),
m AS (SELECT doc_id, item_id, w.size, s, sum(least(w.c, bg.c)) AS i FROM w JOIN bg USING (item_id, g) GROUP BY ALL),
x AS (SELECT doc_id, item_id, s - 1 AS start, i / (2 * (size - 4) - i) AS similarity FROM m)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start, round(min(similarity), 9) AS similarity
FROM (SELECT * FROM x WHERE similarity >= 0.8 QUALIFY similarity = max(similarity) OVER (PARTITION BY doc_id, item_id)) GROUP BY ALL
"""

#: crc32 of a list of bytes: the reflected polynomial, a byte at a time.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"
_ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"

ORACLE_SQL["op12_exact"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
  doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER g AS kept, sha256(plain) AS text_sha256
FROM n WINDOW g AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
# Trees grow by levels and proofs by steps; the subroots are the leaves of a tree with number 0.
ORACLE_SQL["op13_merkle"] = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC.format(_ID_BYTES)} % 3 = 0 THEN {_LEAF.format(_ASCII_LOWER.format("text"))} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS m FROM d),
t(tree, level, idx, m, h) AS MATERIALIZED (SELECT tree, 0, idx, m, leaf FROM l UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE m > 1 GROUP BY tree, idx // 8),
r AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS m FROM t WHERE m = 1),
u(tree, level, idx, m, h) AS MATERIALIZED (SELECT 0, 0, idx, m, subroot FROM r UNION ALL
  SELECT 0, any_value(level) + 1, idx // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE m > 1 GROUP BY idx // 8),
every AS MATERIALIZED (SELECT * FROM t UNION ALL SELECT * FROM u),
s AS MATERIALIZED (SELECT a.tree, a.level, a.idx, a.m, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 GROUP BY ALL),
f AS (SELECT doc_id, l.tree AS of, l.tree, 0 AS level, l.idx, l.idx AS start, '' AS proof, coalesce(other, leaf) AS h FROM l UNION ALL
  SELECT doc_id, of, CASE WHEN s.m > 1 THEN f.tree ELSE 0 END, CASE WHEN s.m > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN s.m > 1 THEN f.idx // 8 ELSE f.of - 1 END, start,
    proof || CASE WHEN s.m > 1 THEN before || after ELSE '' END, CASE WHEN s.m > 1 THEN sha256(before || f.h || after) ELSE f.h END
  FROM f JOIN s ON f.tree = s.tree AND f.level = s.level AND f.idx = s.idx WHERE f.tree > 0 OR s.m > 1)
SELECT l.doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM f JOIN u top ON f.tree = 0 AND f.level = top.level AND f.idx = top.idx AND top.m = 1 JOIN l ON f.of = l.tree AND f.start = l.idx JOIN r ON r.tree = l.tree, (SELECT h FROM u WHERE m = 1) root
"""

# Bytes of a word: letters beyond ASCII are U+00C0 to U+00FF, two bytes in UTF-8. Near words share
# what is left without the letter at the same place, or one is what is left of the other.
_WORD_BYTES = "flatten(list_transform(string_split(w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))"
ORACLE_SQL["op11_spelling"] = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c FROM r WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {_CRC.format("list_concat(" + _ID_BYTES + ", [58], " + _WORD_BYTES + ")")} AS h FROM g),
v AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM h
  GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
k AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON k.x = v.word UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON k.x = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, row(-near_n, near)) AS form, max(near_n) AS form_n, any_value(n) AS n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.further = f.word)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word AND c.further IS NULL
"""
