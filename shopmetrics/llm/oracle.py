"""DuckDB SQL for the queries that SQL can express."""

_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
found AS (
    SELECT p.doc_id, p.i, p.size, v.item_id
    FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM places) p
    JOIN windows v ON p.size = v.size AND p.s = v.s),
hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM found))
    GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (
    SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS s
    FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM d WHERE len(l) >= 3)),
later AS (
    SELECT doc_id, p
    FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k
          FROM w WHERE trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')
    WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(p, p + 3)) AS x FROM later)),
figures AS (
    SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before = x - 1 THEN 0 ELSE 1 END) AS n_spans
    FROM (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS before FROM gone) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS x FROM d),
kept AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY x) AS text
    FROM lines LEFT JOIN gone USING (doc_id, x) WHERE gone.x IS NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN l IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM d LEFT JOIN figures USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

EMBED_DEDUP = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(low.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree ON e.vec_id = degree.a LEFT JOIN low ON e.vec_id = low.a
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
edges AS (SELECT doc_id, p, CASE WHEN lag(p) OVER o >= p - 100 THEN 0 ELSE 1 END AS new FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b
         FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
parts AS (
    SELECT doc_id, a, substr(x, 2 * before + 1, 2 * (a - before)) AS s FROM cuts JOIN d USING (doc_id)
    UNION ALL
    SELECT doc_id, 1e18, substr(x, 2 * m + 1) FROM d JOIN (SELECT doc_id, max(b) AS m FROM runs GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(s, '' ORDER BY a) AS x FROM parts GROUP BY doc_id),
figures AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN figures USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CONVERSATION_TRIE = """
WITH RECURSIVE own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: list_transform(range(8), lambda k: (ascii(s) >> CAST(k AS INTEGER)) & 1))) AS b
    FROM (SELECT DISTINCT c FROM own)),
crc(c, b, i, x) AS (
    SELECT c, b, 1, CAST(4294967295 AS BIGINT) FROM bits
    UNION ALL
    SELECT c, b, i + 1, xor(x >> 1, ((x & 1) + b[i]) % 2 * CAST(3988292384 AS BIGINT)) FROM crc WHERE i <= len(b)),
convs AS (SELECT c, c - c % 5 AS base, xor(x, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i > len(b)),
whole AS (
    SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN own ON own.c = base AND pos <= h
    UNION ALL
    SELECT convs.c, 1, pos, role, text FROM convs JOIN own ON own.c = convs.c AND pos > h),
turns AS (
    SELECT c, row_number() OVER w AS d, octet_length(encode(text)) AS size,
           string_agg(sha256(len(role) || ':' || role || text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
    FROM whole WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
places AS (SELECT c, d, size, sha256(path) AS node FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT node, min(c) AS c, any_value(d) AS d, count(*) AS n, any_value(size) AS size FROM places GROUP BY node),
up AS (SELECT DISTINCT a.node, b.node AS parent FROM places a JOIN places b ON a.c = b.c AND a.d = b.d + 1),
children AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY parent),
above AS (  -- every node with each of its ancestors, itself included
    SELECT nodes.node, nodes.n, nodes.size, p.node AS over FROM nodes JOIN places p ON p.c = nodes.c AND p.d <= nodes.d),
subtrees AS (
    SELECT over AS node, sum((above.n - 1) * size) AS saved, count(*) FILTER (children.n IS NULL) AS leaves
    FROM above LEFT JOIN children USING (node) GROUP BY over),
ends AS (
    SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
    FROM (SELECT c, arg_max(node, d) AS node FROM places GROUP BY c) GROUP BY node)
SELECT nodes.c AS conv_id, CAST(nodes.d AS BIGINT) AS depth, p.c AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN subtrees USING (node) LEFT JOIN up USING (node) LEFT JOIN nodes p ON p.node = up.parent
     LEFT JOIN children ON children.node = nodes.node LEFT JOIN ends ON ends.node = nodes.node
"""
