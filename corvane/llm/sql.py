"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT r, i, l.n, list_slice(w, i, i + l.n - 1) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc) d
  JOIN (SELECT DISTINCT n FROM win) l ON i + l.n - 1 <= len(w)
), occ AS (SELECT r, i, n, item_id FROM gram JOIN win USING (n, g)
), hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r
), ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r
), e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL) p JOIN n na ON p.a = na.r JOIN n nb ON p.b = nb.r
  WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) AS size,
         length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '[', '')) AS rsize,
         coalesce(lag(role) OVER w = role, false) AS again, coalesce(lead(role) OVER w <> role, true) AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 5 WHEN 'system' THEN 5 ELSE 12 + rsize END + again::INT
         + CASE WHEN NOT last THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 6 ELSE 7 END AS marks
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(size + marks))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT r, c, last, substr(h, 1000 * c + 1, 1398) AS p FROM (SELECT r, h, length(h) // 2 - 200 AS last, unnest(range(0, length(h) // 1000 + 1)) AS c FROM d WHERE length(h) >= 400)
), w AS (
  SELECT r, 500 * c + j AS i, md5_number(substr(p, 2 * j + 1, 400)) AS m FROM (SELECT *, unnest(range(0, 500)) AS j FROM part) WHERE 500 * c + j <= last
), again AS (SELECT r, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)
), cut AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again
), span AS (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM cut) GROUP BY r, k
), gap AS (
  SELECT r, k, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY k), 0) AS a, lo AS b FROM span
  UNION ALL SELECT r, 1000000000, max(hi), NULL FROM span GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), length(h))), '' ORDER BY k) AS left_over FROM gap JOIN d USING (r) GROUP BY r
), cuts AS (SELECT r, sum(hi - lo) AS removed, count(*) AS spans FROM span GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN cuts USING (r) LEFT JOIN kept USING (r)
"""


def op9(shards: list[str], owners: list[int], size: int) -> str:
    """Placement through the literal lookup table."""
    return f"""
WITH t AS (SELECT string_split('{",".join(map(str, owners))}', ',') AS o, {shards!r} AS s),
k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, slot, s[o[slot + 1]::INT + 1] AS shard FROM k, t
"""


OP10 = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p
), bits AS (
  SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT r, k, (16384 * a + 0)::INT AS z, v FROM (
    SELECT r, k, 0 AS a, (('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS v
    FROM d, range(32) g(k)))
  GROUP BY r
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id >= top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id >= top THEN NULL ELSE top END AS refers_to
FROM d JOIN bits USING (r)
"""


OP12 = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(strlen(r)::VARCHAR || ':' || r || x)) AS l,
         xor(list_reduce([4294967295::BIGINT] || flatten([[((ascii(s) >> k) & 1)::BIGINT for k in range(8)] for s in string_split(c::VARCHAR, '')]), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h
  FROM t GROUP BY c
), q AS MATERIALIZED (
  SELECT o.c, list_slice(coalesce(p.l, []), 1, o.h) || list_slice(o.l, o.h + 1, len(o.l)) AS l FROM own o LEFT JOIN own p ON p.c = o.c - o.c % 5
), node AS MATERIALIZED (
  SELECT d, list_slice(l, 1, d) AS k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM q) GROUP BY ALL
), kids AS (
  SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), sub AS (
  SELECT a AS d, list_slice(k, 1, a) AS k, sum(leaf)::BIGINT AS leaves, sum((n - 1) * size)::BIGINT AS saved
  FROM (SELECT node.k, node.n, (kids.n IS NULL)::INT AS leaf, coalesce(strlen(node.k[node.d].x), 0) AS size, unnest(range(0, node.d + 1)) AS a FROM node LEFT JOIN kids USING (d, k)) GROUP BY ALL
)
SELECT node.conv_id, node.d::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node LEFT JOIN kids USING (d, k) JOIN sub USING (d, k) LEFT JOIN node p ON p.d = node.d - 1 AND p.k = list_slice(node.k, 1, node.d - 1)
"""


def all_sql() -> dict[str, str]:
    from .queries import SHARDS
    from .sharding import TABLE_SIZE, lookup_table

    return {"op1_decontamination": OP1, "op4_jaccard_join": OP4, "op5_chat_formatting": OP5, "op8_suffix_dedup": OP8, "op9_sharding": op9(SHARDS, lookup_table(SHARDS), TABLE_SIZE), "op10_warc": OP10, "op12_prefix_tree": OP12}
