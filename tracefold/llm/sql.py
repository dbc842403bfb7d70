"""DuckDB SQL that gives the same rows as the queries of ``queries.py``, where SQL can."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
GRAM = rf"regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS varchar), '') AS item, {GRAM} AS words FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item, words, least(10, len(words)) AS k FROM b WHERE len(words) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS g FROM bl, unnest(range(1, len(words) - k + 2)) AS t(i)),
d AS (SELECT doc_id, coalesce({GRAM}, []) AS words FROM documents),
dw AS (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM grams) AS s, unnest(range(1, len(words) - k + 2)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, i, k, item FROM dw JOIN grams USING (g, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) AS x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS pos, array_to_string(lines[i:i + 2], chr(10)) AS w FROM l, unnest(range(1, len(lines) - 1)) AS t(i)),
f AS (SELECT w, min((doc_id, pos)) AS head FROM w WHERE trim(w, concat(' ', chr(9), chr(10), chr(13))) <> '' GROUP BY w HAVING count(*) > 1),
later AS (SELECT doc_id, pos FROM w JOIN f USING (w) WHERE (doc_id, pos) <> head),
cut AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(pos, pos + 3)) AS t(p)),
kept AS (SELECT doc_id, i - 1 AS pos, lines[i] AS line FROM l, unnest(range(1, len(lines) + 1)) AS t(i)),
rest AS (SELECT k.doc_id, count(c.p) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.p IS NULL) AS kept
         FROM kept AS k LEFT JOIN cut AS c ON c.doc_id = k.doc_id AND c.p = k.pos GROUP BY k.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.lines), 0) AS bigint) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents AS d LEFT JOIN l USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({SPLIT.format(f"translate(text, {AZ})")}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS m ON m.doc_id = a JOIN n AS o ON o.doc_id = b WHERE 100 * c >= 75 * (m.n + o.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce({SPLIT.format("text")}, []) AS w FROM documents),
r AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
f AS (SELECT g, min(doc_id) AS head FROM r GROUP BY g HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, p FROM r JOIN f USING (g), unnest(range(i, i + 50)) AS t(p) WHERE head < doc_id),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
k AS (SELECT word.doc_id, count(cut.p) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE cut.p IS NULL) AS kept
      FROM word LEFT JOIN cut ON cut.doc_id = word.doc_id AND cut.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS bigint) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS int) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP9 = """
WITH k AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, turn, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS b FROM k WHERE role = 'assistant'),
f AS (SELECT pair_id, turn AS at, text FROM l WHERE b = 1),
m AS (SELECT k.*, f.pair_id IS NOT NULL AND coalesce(role = 'assistant', false) AND k.turn IS NOT DISTINCT FROM f.at AS final, o.pair_id IS NOT NULL AS has_other, o.text AS other
      FROM k LEFT JOIN f USING (pair_id) LEFT JOIN f AS o ON o.pair_id = xor(k.pair_id, 1)),
s AS (SELECT pair_id, false AS side, turn, role, text FROM k UNION ALL SELECT pair_id, true, turn, role, CASE WHEN final THEN other ELSE text END FROM m WHERE NOT final OR has_other),
t AS (SELECT pair_id, side, role, '<|' || coalesce(role, 'none') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body,
             row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM s),
pairs AS (SELECT pair_id, count(*) FILTER (WHERE NOT side) AS nc, count(*) FILTER (WHERE side) AS nr FROM t GROUP BY pair_id),
diff AS (SELECT c.pair_id, min(c.i) AS i FROM (SELECT * FROM t WHERE NOT side) AS c LEFT JOIN (SELECT * FROM t WHERE side) AS r ON c.pair_id = r.pair_id AND c.i = r.i
         WHERE r.i IS NULL OR c.head || c.body <> r.head || r.body GROUP BY c.pair_id),
n AS (SELECT pair_id, nc, nr, CASE WHEN nc = 0 THEN 0 ELSE coalesce(diff.i - 1, nc) END AS p FROM pairs LEFT JOIN diff USING (pair_id)),
u AS (SELECT t.*, p, i > p AS rest, sum(length(head) + length(body)) FILTER (WHERE i > p) OVER (PARTITION BY pair_id, side ORDER BY i) AS e FROM t JOIN n USING (pair_id)),
a AS (SELECT pair_id, string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT side AND NOT rest) AS prompt,
             string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT side AND rest) AS chosen, string_agg(head || body, '' ORDER BY i) FILTER (WHERE side AND rest) AS rejected,
             string_agg((e - length(body)) || ':' || e, ',' ORDER BY i) FILTER (WHERE NOT side AND rest AND role = 'assistant') AS chosen_mask,
             string_agg((e - length(body)) || ':' || e, ',' ORDER BY i) FILTER (WHERE side AND rest AND role = 'assistant') AS rejected_mask FROM u GROUP BY pair_id)
SELECT pair_id, CAST(p AS int) AS n_prompt, CAST(nc - p AS int) AS n_chosen, CAST(nr - p AS int) AS n_rejected, coalesce(prompt, '') AS prompt,
       coalesce(chosen, '') AS chosen, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM n JOIN a USING (pair_id)
UNION ALL SELECT NULL, 0, 1, 0, '', h || b, CASE WHEN role = 'assistant' THEN length(h) || ':' || length(h || b) ELSE '' END, '', ''
FROM (SELECT role, '<|' || coalesce(role, 'none') || '|>' || chr(10) AS h, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS b FROM conversations WHERE conv_id IS NULL) AS z
"""

ASSIGN = """(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in ASSIGN[:39]) + ASSIGN[39:]
LIVE = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10"


def _matches(kind: int, pattern: str, group: int) -> str:
    """The matches of a pattern with the code points from the match before."""
    return (
        f"SELECT row, repository, owner, {kind} AS kind, i, length(string_split_regex(text, '{pattern}')[i]) AS gap, length(regexp_extract_all(text, '{pattern}')[i]) AS len,"
        f" regexp_extract_all(text, '{pattern}', {group})[i] AS value FROM d, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS t(i)"
    )


OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, CAST(doc_id AS varchar) AS repository, source AS owner, coalesce(text, '') AS text FROM documents),
m AS ({_matches(0, ASSIGN, 2)} UNION ALL {_matches(1, "AKIA[A-Z0-9]{16,}", 0)} UNION ALL {_matches(2, "[0-9a-f]{24,}", 0)} UNION ALL {_matches(3, "[A-Za-z0-9+/_=-]{20,}", 0)}),
p AS (SELECT *, sum(gap + len) OVER (PARTITION BY row, kind ORDER BY i) AS e FROM m),
s AS (SELECT row, repository, owner, kind, e - len AS b, e, value FROM p WHERE CASE kind WHEN 0 THEN length(value) >= 6 WHEN 3 THEN {LIVE} ELSE true END),
k AS (SELECT * FROM s WHERE kind < 3 OR NOT EXISTS (FROM s AS o WHERE o.row = s.row AND o.kind < 3 AND o.b < s.e AND s.b < o.e)),
n AS (SELECT value, count(DISTINCT coalesce('0' || repository, '1')) AS r, count(DISTINCT coalesce('0' || owner, '1')) AS o FROM k GROUP BY value),
j AS (SELECT k.*, o <= 2 AND r <= 10 AS own, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(b AS bigint) || ':' || CAST(e AS bigint) AS said, {LIVE} AS live FROM k JOIN n USING (value)),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
      string_agg(said, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base, string_agg(said, ',' ORDER BY b, kind) FILTER (WHERE kind < 3 OR own) AS spans,
      count(*) FILTER (WHERE kind < 3 AND own AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT own) AS n_example FROM j GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (row)
"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS varchar), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS bigint) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS bigint)) AS h FROM d),
k AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

#: CRC-32 of a decimal number, bit by bit.
CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), flatten(list_transform(string_split(CAST({} AS varchar), ''), lambda c: [CAST(ascii(c) AS bigint), 0, 0, 0, 0, 0, 0, 0]))),"
    " lambda s, v: xor(xor(s, v) >> 1, (xor(s, v) & 1) * 3988292384)), 4294967295)"
)

OP12 = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, {CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o) AS x),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.donor AND i <= h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
t AS (SELECT conv_id, row_number() OVER w AS depth, sha256(role || chr(1) || text) AS x, strlen(text) AS b FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT conv_id, depth, b, sha256(string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, lag(key) OVER w AS above, lead(key) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT key, any_value(depth) AS depth, any_value(above) AS above, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM m GROUP BY key),
k AS (SELECT above AS key, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT DISTINCT y.key AS top, z.key FROM m AS y JOIN m AS z ON z.conv_id = y.conv_id AND z.depth >= y.depth),
u AS (SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n - 1) * b) AS saved FROM s JOIN n USING (key) LEFT JOIN k USING (key) GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS bigint) AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS bigint) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n LEFT JOIN k USING (key) JOIN u ON u.top = n.key LEFT JOIN n AS q ON q.key = n.above
"""

ORACLE = {"op11_fill_in_middle": OP11, "op12_prefix_trie": OP12, "op7_secret_scan": OP7, "op5_top_k": OP5, "op9_preference_format": OP9, "op8_substring_dedup": OP8, "op1_decontaminate": OP1, "op6_near_duplicates": OP6, "op10_line_dedup": OP10}
