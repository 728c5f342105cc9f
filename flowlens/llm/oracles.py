"""DuckDB twins of the queries that SQL can express whole: near-duplicates, repeated windows, near vectors.

The rest depend on hashes, trained models, a tokenizer or iteration that SQL lacks; they are tested against plain versions.
"""

from __future__ import annotations

_WORDS = r"""list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From links ``l(a, b)`` and nodes ``nodes(id)`` to ``reached(id, root)``: every id with the smaller ids it can reach.
_REACH = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reached(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM reached r JOIN e ON e.a = r.id WHERE r.root < e.b)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
 SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, min(root) = id AS kept FROM reached LEFT JOIN n ON n.doc_id = id GROUP BY id"""

WITHOUT_REPEATS = f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
 later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
 word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
 kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS double[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95e0),
 nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
 d AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
 SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, min(root) = id AS kept FROM reached LEFT JOIN d USING (id) GROUP BY id"""

#: Per byte, what a CRC-32 of that byte adds; then the checksum of a decimal number.
_CRC_TABLE = """ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1
  THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

PREFIX_TRIE = f"""WITH {_CRC_TABLE},
 o AS (SELECT conv_id, list(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS l,
  list(octet_length(encode(coalesce(text, ''))) ORDER BY turn NULLS FIRST, role, text) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 h AS (SELECT conv_id, l, s, {_CRC.format(text="conv_id::varchar")} % 9 AS h FROM o, ct),
 r AS (SELECT h.conv_id, list_concat(coalesce(o.l[1:h], []), h.l[h + 1:]) AS l, list_concat(coalesce(o.s[1:h], []), h.s[h + 1:]) AS s
  FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
 p AS (SELECT conv_id, d, len(l) AS n, sha256(array_to_string(l[1:d], ',')) AS k, coalesce(s[d], 0) AS b FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
 node AS (SELECT d, k, min(conv_id) AS c, count(*) AS n, any_value(b) AS b,
  sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = d), '')) AS e FROM p GROUP BY 1, 2),
 path AS (SELECT p.conv_id, p.d, node.c FROM p JOIN node USING (d, k)),
 up AS (SELECT m.*, path.c AS parent FROM node m LEFT JOIN path ON path.conv_id = m.c AND path.d = m.d - 1),
 kids AS (SELECT d - 1 AS d, parent AS c, count(*) AS n FROM up WHERE d > 0 GROUP BY 1, 2),
 v AS (SELECT up.*, coalesce(kids.n, 0) AS kids FROM up LEFT JOIN kids USING (d, c)),
 total AS (SELECT path.d, path.c, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * b)::bigint AS saved FROM v JOIN path ON path.conv_id = v.c AND path.d <= v.d GROUP BY 1, 2)
 SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, e AS ends_sha256
 FROM v JOIN total USING (d, c)"""

_FAILS = {
    "A": "len(ws) < 50", "B": "100 * len(list_distinct(ws)) < 65 * len(ws)", "C": "100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x)",
    "D": "regexp_matches(x, '[#$%&*|]')", "E": "coalesce(first_id < doc_id, false)"}

FILTER_AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, {_WORDS.format(text="coalesce(text, '')")} AS ws,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
 lab AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, {" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_FAILS.values()))} AS m,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN lab USING (doc_id)),
 c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
  list_sum(list_transform(range(1, step), lambda j: 1 << (instr('ABCDE', filter_order[j]) - 1))) AS before FROM o, range(1, 6) AS r(step)),
 t AS (SELECT part, filter_order, step, bit, coalesce(before, 0)::bigint AS before FROM s, (SELECT DISTINCT part FROM c)),
 g AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & before > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM t JOIN c USING (part) GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM g"""
