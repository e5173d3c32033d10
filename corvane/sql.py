"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from corvane.queries import BUDGET, PLANTED, PLANTED_STEPS

_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1)"

_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]|\p{Cf}"
_CODES = r"%[0-9a-fA-F]{2}|&(?:#|sol;|bsol;|frasl;|num;|percnt;|colon;|period;|hyphen;|minus;|lowbar;|commat;|tab;|newline;)|[\x{2010}\x{2011}\x{2212}\x{2044}\x{2215}\x{2216}\x{FB00}-\x{FB06}\x{FF01}-\x{FF5E}]"


def _based(path: str) -> str:
    own = f"('/' || ltrim({path}, '/'))"
    return f"CASE WHEN {own} = '/site' OR starts_with({own}, '/site/') THEN {own} ELSE '/site' || {own} END"


def _bare(path: str) -> str:
    return f"CASE WHEN {path} = '/site' THEN '/' WHEN starts_with({path}, '/site/') THEN substr({path}, 6) WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END"


def _localized(locale: str) -> str:
    prefix, error = ("/en", "/404/") if locale == "en" else ("", "/404.html")
    return _based(f"('{prefix}' || CASE WHEN regexp_matches(route, '^/404(?:\\.html|/)?$') THEN '{error}' ELSE route END)") + " || tail"


SQL = {
    "resolved_citations": """
        SELECT o_orderkey, ordinal, p_partkey, p_name FROM (
          SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem)
        JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "missing_references": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "reverse_closure": """
        SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "bijection_report": """
        SELECT coalesce(d.doc_id, l.doc_id) AS key, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS status
        FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
        WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "overlay_localised": "SELECT doc_id AS id, lang, upper(source) AS source FROM documents",
    "overlay_gaps": "SELECT doc_id AS id, 'source' AS field FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)",
    "grouped_bibliography": """
        SELECT list_position(['en', 'fr', 'de', 'es', 'ru'], lang) - 1 AS ordinal, lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS n_long,
               CASE WHEN count(*) < 10 THEN '0' ELSE '' END || count(*) AS padded
        FROM documents WHERE lang IN ('en', 'fr', 'de', 'es', 'ru') GROUP BY lang""",
    "year_desc_nulls_last": """
        SELECT *, '0' || position AS label FROM (
          SELECT doc_id, lang, coalesce(quality, -1) AS quality, row_number() OVER (PARTITION BY lang ORDER BY labels.quality DESC NULLS LAST, lpad(doc_id::VARCHAR, 12, '0')) AS position
          FROM documents LEFT JOIN labels USING (doc_id))""",
    "top4_chronology": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4",
    "code_unit_order": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name COLLATE C, p_partkey) AS position FROM part",
    "route_locale_cross": """
        WITH r AS (SELECT '/' || lower(n_name) || '/' AS route FROM nation),
        l AS (SELECT unnest(['ru', 'en']) AS locale, unnest(['', '/en']) AS pre)
        SELECT route, locale, '<url><loc>https://example.org' || pre || route || '</loc><xhtml:link rel="alternate" hreflang="ru" href="https://example.org' || route
               || '"/><xhtml:link rel="alternate" hreflang="en" href="https://example.org/en' || route || '"/></url>' AS entry FROM r, l""",
    "attribute_pivot": "SELECT attribute, " + ", ".join(f"max(value) FILTER (k = {k}) AS \"{k}\"" for k in range(5)) + """ FROM (
          SELECT r_regionkey AS k, 'r_name' AS attribute, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'r_regionkey', r_regionkey::VARCHAR FROM region) GROUP BY attribute""",
    "layer_unpivot": """
        SELECT p_partkey, 'p_name' AS layer, p_name AS value FROM part WHERE p_name IS NOT NULL
        UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_brand IS NOT NULL
        UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type IS NOT NULL""",
    "exact_cardinality": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders",
    "duplicate_keys": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "set_equality": "SELECT conv_id, bool_and(role IN ('user', 'assistant')) AND count(DISTINCT role) = 2 AS same FROM conversations GROUP BY conv_id",
    "multiset_equality": """
        SELECT nation, sum(d)::BIGINT AS surplus FROM (SELECT c_nationkey AS nation, 1 AS d FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier)
        GROUP BY nation HAVING sum(d) <> 0""",
    "adjacent_order_check": "SELECT event_id, user_id, previous, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous > value",
    "running_byte_budget": f"""
        SELECT doc_id, running::BIGINT AS running FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)
        WHERE running > {BUDGET}""",
    "count_vs_manifest": """
        SELECT collection, coalesce(declared, 0)::BIGINT AS declared, coalesce(observed, 0)::BIGINT AS observed
        FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'ru']) AS collection, 100 AS declared)
        FULL JOIN (SELECT lang AS collection, count(*) AS observed FROM documents GROUP BY lang) USING (collection) WHERE coalesce(declared, 0) <> coalesce(observed, 0)""",
    "snapshot_diff": """
        WITH b AS (SELECT o_orderkey, o_orderstatus s, o_orderpriority p, o_totalprice t FROM orders WHERE o_orderpriority <> '5-LOW'),
        a AS (SELECT o_orderkey, o_orderstatus s, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END p, o_totalprice t FROM orders WHERE o_orderstatus <> 'P')
        SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
          CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN (a.s, a.t) <> (b.s, b.t) OR a.p IS DISTINCT FROM b.p THEN 'changed' END AS change
          FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL""",
    "copies_differ": """
        SELECT * FROM (SELECT d.doc_id AS name, CASE WHEN l.doc_id IS NULL THEN 'extra' WHEN d.n_chars IS DISTINCT FROM l.quality THEN 'differs' END AS problem
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE problem IS NOT NULL""",
    "payload_digest": """
        SELECT doc_id // 1000 AS bucket, sha256(unhex(hex('payload-v1' || chr(10)) || string_agg(
          lpad(hex(strlen(doc_id::VARCHAR)), 16, '0') || hex(doc_id::VARCHAR) || lpad(hex(strlen(text)), 16, '0') || hex(text), '' ORDER BY doc_id::VARCHAR COLLATE C))) AS digest
        FROM documents GROUP BY bucket""",
    "framed_digest": "SELECT doc_id, sha256(unhex(lpad(hex(strlen(text)), 16, '0') || hex(text))) AS sha256 FROM documents",
    "reading_minutes": r"""
        SELECT doc_id, words, greatest(1, ceil(words / 220))::INT AS minutes FROM (
          SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[\p{M}''’-][\p{L}\p{M}\p{N}]+)*')) AS words FROM documents)""",
    "control_characters": r"SELECT doc_id, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]|\p{Cf}') AS flagged FROM documents",
    "base_path": f"SELECT page_id, based, {_bare('based')} AS bare FROM (SELECT page_id, {_based('path')} AS based FROM (SELECT page_id, {_PATH} AS path FROM pages))",
    "locale_path": f"""
        SELECT page_id, CASE WHEN regexp_matches(bare_root, '^/en(?:/|$)') THEN 'en' ELSE 'ru' END AS locale, {_localized('ru')} AS path_ru, {_localized('en')} AS path_en FROM (
          SELECT *, CASE WHEN b = '/en' THEN '/' WHEN starts_with(b, '/en/') THEN substr(b, 4) ELSE b END AS route FROM (
            SELECT *, {_bare('head')} AS b FROM (
              SELECT page_id, CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS bare_root,
                     CASE WHEN regexp_extract(path, '^([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(path, '^([^?#]*)', 1) END AS head,
                     substr(path, length(regexp_extract(path, '^([^?#]*)', 1)) + 1) AS tail FROM (SELECT page_id, {_PATH} AS path FROM pages))))""",
    "url_safety": r"""
        SELECT page_id, regexp_matches(url, '^https://[^\s/?#@:]+(?::\d+)?(?:[/?#]\S*)?$') AS https,
               regexp_matches(url, '(?i)(?:^|[^a-z0-9+.-])(?:data|file|javascript|vbscript)\s*:') AS dangerous,
               CASE WHEN regexp_matches(url, '(?i)^https?://') THEN lower(regexp_replace(regexp_extract(url, '^[^/]+://[^/?#]+'), '^(http)://([^:]*):80$|^(https)://([^:]*):443$', '\1\3://\2\4')) END AS origin
        FROM pages""",
    # An address of another scheme than https says where a host is, as a network share does.
    "safe_links": "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url END AS value, CASE WHEN url NOT LIKE 'https://%' THEN 'local path' END AS error FROM pages",
    # Where a text holds neither codes nor look-alikes nor controls, it is its own canonical form.
    "canonical_text": rf"""
        SELECT doc_id, CASE WHEN NOT regexp_matches(text, '{_CONTROLS}') AND NOT regexp_matches(text, '{_CODES}') THEN sha256(text) END AS sha256,
               CASE WHEN regexp_matches(text, '{_CONTROLS}') THEN 'control or format character' WHEN regexp_matches(text, '{_CODES}') THEN 'not judged here' END AS error FROM documents""",
    "private_sentinel": rf"""
        SELECT doc_id, CASE WHEN regexp_matches(text, '{_CONTROLS}') THEN 'control or format character' WHEN regexp_matches(text, '(?i)(?:^|[^a-z0-9._-])src1[/\\]+the(?:[^a-z0-9_-]|$)') THEN 'repository coordinate'
          WHEN regexp_matches(text, '(?i)(?:^|[^a-z0-9_])(?:claim|object|media|source|interlude)-[a-z0-9-]') THEN 'internal identifier'
          WHEN regexp_matches(regexp_replace(text, '(?i)https://[^\s]+', ' ', 'g'), '(?i)(?:^|[^a-z0-9._-])(?:drafts/|[a-z]:[/\\]|~/)|[/\\](?:users|home|private)/[^\s]|(?:^|[^a-z0-9._:-])//[^/\s]+/') THEN 'local path' END AS leak FROM documents""",
    "slug_check": r"""
        SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) >= 4 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 4, '0') END AS padded, '0' || p_partkey AS numbered,
               regexp_matches(lower(replace(p_brand, '#', '-')), '^[a-z0-9]+(?:-[a-z0-9]+)*$') AND NOT regexp_matches(lower(p_brand), '^(?:claim|object|media|source|interlude)#') AS neutral FROM part""",
    "payload_paths": r"""
        SELECT doc_id, CASE WHEN lang = 'en' AND regexp_matches(lower(source), '^[a-z0-9-]+$') THEN 'note' END AS kind, true AS normal, 'note-' || lower(source) AS stem FROM documents""",
    "text_escapes": """
        SELECT page_id, replace(replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS encoded,
               replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
    "code_unit_length": r"SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS units FROM documents",
    "masked_ranges": "SELECT p_partkey, '  ' || substr(p_name, 3, 1) || ' ' || substr(p_name, 5) AS masked FROM part",
    "clamped_neighbours": "SELECT p_partkey, least(100.0, greatest(0.0, p_retailprice / 20)) AS clamped, greatest(0, least(49, p_size + 1)) AS next, (p_size + 1) % 50 AS wrapped FROM part",
    "iso_dates": "SELECT o_orderkey, o_orderstatus = 'F' AS valid FROM orders",
    "evidence_labels": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'Клинические данные' WHEN toxic = 1 THEN 'Доказательств нет' ELSE 'Традиционное представление' END AS label_ru,
               CASE WHEN quality = 1 THEN 'Clinical evidence' WHEN toxic = 1 THEN 'No supporting evidence' ELSE 'Traditional belief' END AS label_en FROM labels""",
    "set_operations": """
        SELECT 'union' AS op, nation FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'difference', nation FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT DISTINCT 'member', c_nationkey FROM customer WHERE c_nationkey IN (1, 2, 3)""",
    "strict_json": "SELECT event_id, CASE WHEN json_valid(props) THEN NULL ELSE 'syntax' END AS problem, len(list_filter(json_keys(props), lambda k: k <> 'k'))::INT AS unknown FROM events",
    "row_violations": """
        SELECT 'doc.short' AS check_id, doc_id::VARCHAR AS record_id, 'n_chars' AS path, 'too short' AS message FROM documents WHERE NOT coalesce(n_chars >= 100, false)
        UNION ALL SELECT 'doc.lang', doc_id::VARCHAR, 'lang', 'unknown' FROM documents WHERE NOT coalesce(lang IN ('en', 'fr', 'de', 'es', 'ru'), false)
        UNION ALL SELECT 'doc.length', doc_id::VARCHAR, 'text', 'another length' FROM documents WHERE NOT coalesce(length(text) = n_chars, false)""",
    "html_links": """
        SELECT page_id, len(regexp_extract_all(html, '(?i)<[a-z][^<>]*\\s(?:href|src)="')) AS n_links FROM pages""",
    "canonical_json": "SELECT event_id, '{' || chr(10) || '  \"k\": ' || (props ->> 'k') || chr(10) || '}' || chr(10) AS value, NULL AS error FROM events",
    "html_problems": " UNION ALL ".join(f"SELECT page_id, '{where}' AS \"where\", '{problem}' AS problem, 1::BIGINT AS n FROM pages WHERE page_id % {PLANTED_STEPS} = {k}" for k, (_, found) in PLANTED.items() for where, problem in found),
}
