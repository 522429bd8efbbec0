"""Oracles of the queries on stored things."""

from __future__ import annotations

from cartulary.sources.raw import SCHEMAS

from .base import KEY
from .retrieval import TABLES as BASE

REL = f"{KEY}, relation_id"
# Children in a document, lines in a page part.
SIZE, LINES = 200, 200
RULE = "substr(md5(relation_id), 1, 2)"


def _changed(part: str, table: str) -> str:
    return (
        f"SELECT catalog_id, relation_id, '{part}' AS part, CAST(sum(greatest(d, 0)) AS BIGINT) AS came, CAST(sum(greatest(-d, 0)) AS BIGINT) AS gone FROM ("
        f"SELECT * EXCLUDE (sign), sum(sign) AS d FROM (SELECT * EXCLUDE (snapshot_id), CASE snapshot_id WHEN 's2' THEN 1 ELSE -1 END AS sign FROM {table}) x GROUP BY ALL) y "
        "WHERE d <> 0 GROUP BY catalog_id, relation_id")


TABLES = BASE
TABLES.update({
    "child": f"""
SELECT {REL}, 0 AS kind, ordinal, '' AS further, name FROM col UNION ALL SELECT {REL}, 1, 0, '', name FROM con UNION ALL SELECT {REL}, 2, 0, '', name FROM fk
UNION ALL SELECT {REL}, 3, 0, '', name FROM idx
UNION ALL SELECT f.catalog_id, f.snapshot_id, f.ref, 4, 0, f.relation_id, f.name FROM fk f JOIN rel r ON r.catalog_id = f.catalog_id AND r.snapshot_id = f.snapshot_id AND r.relation_id = f.ref""",
    "placed_child": f"SELECT *, row_number() OVER (PARTITION BY {REL} ORDER BY kind, ordinal, further, name) AS position FROM child",
    "saved_part": f"""
SELECT {REL}, CAST((position - 1) // {SIZE} AS INTEGER) AS part, count(*) FILTER (kind = 0) AS n_columns, count(*) FILTER (kind = 1) AS n_constraints,
  count(*) FILTER (kind = 2) AS n_foreign_keys, count(*) FILTER (kind = 3) AS n_indexes, count(*) FILTER (kind = 4) AS n_referenced_by, sha256(string_agg(name, '|' ORDER BY position)) AS names
FROM placed_child GROUP BY ALL""",
    "saved_doc": f"""
SELECT {REL}, part, max(part) OVER (PARTITION BY {REL}) + 1 AS parts, part = 0 AS has_head, n_columns, n_constraints, n_foreign_keys, n_indexes, n_referenced_by, names FROM saved_part
UNION ALL SELECT {REL}, 0, 1, true, 0, 0, 0, 0, 0, sha256('') FROM rel r WHERE NOT EXISTS (SELECT 1 FROM saved_part p WHERE p.catalog_id = r.catalog_id AND p.snapshot_id = r.snapshot_id AND p.relation_id = r.relation_id)""",
    "line": f"""
SELECT *, {RULE} AS rule, CASE WHEN part = 0 THEN CASE {RULE} WHEN '00' THEN 'unreadable' WHEN '01' THEN 'head_incomplete' WHEN '02' THEN 'kind_unknown' WHEN '06' THEN 'part_outside'
  WHEN '07' THEN CASE WHEN n_constraints > 0 THEN 'child_incomplete' END END END AS flaw
FROM saved_doc WHERE NOT ({RULE} = '05' AND parts > 1 AND part = parts - 1)""",
    "good_line": "SELECT * FROM line WHERE flaw IS NULL UNION ALL SELECT * FROM line WHERE rule = '03' AND part = 0",
    "history": """
SELECT catalog_id, snapshot_id, relation_id, hash FROM hashes
UNION ALL SELECT catalog_id, 's3', relation_id, CASE WHEN substr(md5(relation_id), 1, 1) IN ('0', '1') THEN sha256(hash) ELSE hash END FROM hashes WHERE snapshot_id = 's2' AND substr(md5(relation_id), 1, 1) <> '2'
UNION ALL SELECT catalog_id, 's4', relation_id, CASE WHEN substr(md5(relation_id), 1, 1) = '1' THEN sha256(hash) ELSE hash END FROM hashes WHERE snapshot_id = 's2' AND substr(md5(relation_id), 1, 1) <> '3'""",
    "moment": "SELECT catalog_id, snapshot_id, row_number() OVER (PARTITION BY catalog_id ORDER BY snapshot_id) AS spot FROM (SELECT DISTINCT catalog_id, snapshot_id FROM history) x",
    # An interval begins where the snapshot before has another hash or none.
    "dated": """
SELECT h.*, m.spot, lag(m.spot) OVER w AS before_spot, lag(h.hash) OVER w AS before_hash FROM history h JOIN moment m ON m.catalog_id = h.catalog_id AND m.snapshot_id = h.snapshot_id
WINDOW w AS (PARTITION BY h.catalog_id, h.relation_id ORDER BY m.spot)""",
    "dated_run": """
SELECT *, sum(CASE WHEN before_spot = spot - 1 AND before_hash = hash THEN 0 ELSE 1 END) OVER (PARTITION BY catalog_id, relation_id ORDER BY spot) AS run FROM dated""",
    "part_line": f"""
SELECT {REL}, row_number() OVER (PARTITION BY {REL} ORDER BY list_position(['kind', 'rows', 'partition', 'columns', 'key', 'unique', 'check', 'foreign', 'index', 'used_by', 'view'], section), ordinal, order_key, line) AS position,
  '- ' || section || ': ' || line AS line FROM all_lines""",
    "page_part": f"""
SELECT {REL}, CAST((position - 1) // {LINES} AS INTEGER) AS part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY position) || chr(10) AS text FROM part_line GROUP BY ALL""",
    "page_part_of": f"SELECT *, max(part) OVER (PARTITION BY {REL}) + 1 AS parts FROM page_part",
    "page_whole": f"SELECT {REL}, string_agg(text, '' ORDER BY part) AS text FROM page_part GROUP BY ALL",
    "renewed": """
SELECT l.catalog_id, l.relation_id, l.action, CASE WHEN action IN ('skipped', 'unchanged') THEN l.text WHEN NOT captured THEN rebuilt
  ELSE CASE WHEN action = 'created' THEN '---' || chr(10) || CAST(to_json({'version': 1, 'table': l.relation_id}) AS VARCHAR) || chr(10) || '---' || chr(10) || '<!-- auto:start -->' || chr(10) ELSE head END
    || '<!-- state:' || due_state || ' -->' || chr(10) || '<!-- hash:' || live_hash || ' -->' || chr(10) || '<!-- doc-hash:' || live_doc_hash || ' -->' || chr(10)
    || p.text || CASE WHEN action = 'created' THEN '<!-- auto:end -->' || chr(10) ELSE tail END END AS new_text
FROM life l LEFT JOIN page_whole p ON p.catalog_id = l.catalog_id AND p.relation_id = l.relation_id""",
    "listing": " UNION ALL ".join(f"SELECT catalog_id, snapshot_id, '{name}' AS part, count(*) AS found FROM raw_{name} GROUP BY catalog_id, snapshot_id" for name in SCHEMAS),
    "set_scope": """
SELECT catalog_id, snapshot_id, position, schema FROM raw_scopes WHERE right(catalog_id, 1) <> '6'
UNION ALL SELECT catalog_id, snapshot_id, 99, CASE WHEN right(catalog_id, 1) = '5' THEN schema ELSE '' END FROM raw_scopes WHERE schema = 'sales' AND right(catalog_id, 1) IN ('5', '7')""",
    "candidate": """
SELECT r.catalog_id, r.request_id, r.pos, h.relation_id AS candidate FROM resolved r JOIN hit h ON h.catalog_id = r.catalog_id AND h.request_id = r.request_id AND h.pos = r.pos WHERE r.code = 'ambiguous_name'
UNION ALL SELECT r.catalog_id, r.request_id, r.pos, k.relation_id FROM resolved r JOIN known k ON k.catalog_id = r.catalog_id AND lower(k.name) = lower(r.parts[-1]) WHERE r.code = 'unknown_relation'""",
})

_LOG = """
SELECT catalog_id, run_id, '2026-09-25T' || moment || 'Z capture: ' || relations || ' relations, ' || enums || ' enums; pages: ' || pages_created || ' new, ' || (pages_updated + pages_reactivated) || ' changed, '
  || pages_removed || ' removed, ' || pages_out_of_scope || ' out of scope, ' || pages_skipped || ' skipped' AS line
FROM summary, (VALUES ('r1', '10:30:00'), ('r2', '11:30:00')) v(run_id, moment)"""

SQL = {
    "saved_documents": "SELECT * FROM saved_doc",
    "saved_roundtrip": "SELECT * FROM hashes",
    "saved_findings": f"""
SELECT CASE WHEN rule <> '00' THEN catalog_id END AS catalog_id, CASE WHEN rule <> '00' THEN snapshot_id END AS snapshot_id, CASE WHEN rule <> '00' THEN relation_id END AS relation_id,
  CASE WHEN rule = '06' THEN -1 WHEN rule <> '00' THEN part END AS part, flaw, NULL AS detail FROM line WHERE flaw IS NOT NULL
UNION ALL SELECT {REL}, NULL, CASE WHEN count(*) > count(DISTINCT part) THEN 'part_repeated' ELSE 'part_missing' END, count(*) || ' of ' || max(parts) FROM good_line GROUP BY {REL}
  HAVING count(*) <> max(parts)
UNION ALL SELECT {REL}, NULL, 'content_changed', 'columns,doc_hash' FROM saved_doc WHERE {RULE} = '04' AND part = 0 AND n_columns > 0""",
    "section_changes": " UNION ALL ".join(_changed(part, table) for part, table in (
        ("columns", "col"), ("constraints", "con"), ("foreign_keys", "fk"), ("indexes", "idx"), ("enums", f"(SELECT c.*, e.schema, e.name, e.\"values\" FROM (SELECT DISTINCT {REL}, enum_id FROM col WHERE enum_id IS NOT NULL) c LEFT JOIN enums e ON e.catalog_id = c.catalog_id AND e.snapshot_id = c.snapshot_id AND e.enum_id = c.enum_id)"))),
    "incremental_hashes": "SELECT * FROM hashes WHERE snapshot_id = 's2'",
    "history_intervals": """
SELECT r.catalog_id, r.relation_id, r.hash, min(r.snapshot_id) AS valid_from, any_value(m.snapshot_id) AS valid_to, count(DISTINCT r.spot) AS snapshots
FROM (SELECT *, max(spot) OVER (PARTITION BY catalog_id, relation_id, run) AS last_spot FROM dated_run) r LEFT JOIN moment m ON m.catalog_id = r.catalog_id AND m.spot = r.last_spot + 1
GROUP BY r.catalog_id, r.relation_id, r.hash, r.run""",
    "published_pages": """
SELECT path, sha256(CASE WHEN action IN ('skipped', 'unchanged') THEN text ELSE rebuilt END) AS stored, true AS "first", action NOT IN ('skipped', 'unchanged') AND rebuilt <> text AS "second", false AS third FROM life WHERE has_page""",
    "run_log_once": _LOG,
    "page_books": "SELECT catalog_id, relation_id, schema, path, sha256(text) AS hash, length(text) AS n_chars FROM note_pages",
    "page_texts": f"SELECT {REL}, part, parts, n_lines, sha256(text) AS text FROM page_part_of",
    "page_refresh": "SELECT catalog_id, relation_id, action, sha256(new_text) AS new_hash, length(new_text) AS n_chars FROM renewed",
    "torn_extracts": """
SELECT catalog_id, snapshot_id, 'rows_differ' AS flaw, part || ': ' || found || ' of ' || (found + 1) AS detail FROM listing WHERE right(catalog_id, 1) = '3' AND snapshot_id = 's1' AND part = 'attributes'
UNION ALL SELECT catalog_id, snapshot_id, 'table_unlisted', part || ': ' || found || ' of none' FROM listing WHERE right(catalog_id, 1) = '8' AND part = 'types'
UNION ALL SELECT catalog_id, snapshot_id, 'several_moments', '2 marks' FROM listing WHERE right(catalog_id, 1) = '5' AND part = 'indexes'""",
    "scope_settings": """
SELECT c.catalog_id, c.snapshot_id, coalesce(string_agg(s.schema, '|' ORDER BY s.position), 'public') AS schemas,
  CASE WHEN bool_or(s.schema = '') THEN 'empty_name' WHEN count(DISTINCT s.schema) < count(s.schema) THEN 'repeated_name' END AS flaw
FROM (SELECT DISTINCT catalog_id, snapshot_id FROM raw_scopes) c LEFT JOIN set_scope s ON s.catalog_id = c.catalog_id AND s.snapshot_id = c.snapshot_id GROUP BY c.catalog_id, c.snapshot_id""",
    "indexed_search": "SELECT * FROM found",
    "bounded_candidates": """
SELECT catalog_id, request_id, pos, candidate, CAST(place AS INTEGER) AS place, greatest(total - 20, 0) AS omitted FROM (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY catalog_id, request_id, pos) AS total FROM candidate WINDOW w AS (PARTITION BY catalog_id, request_id, pos ORDER BY candidate)) x WHERE place <= 20""",
    "scrub_all": """
WITH s AS (SELECT unnest(['hunter' || page_id, 'p@ss-w0rd!' || page_id, 'p%40ss-w0rd!' || page_id]) AS secret FROM pages),
m AS (SELECT page_id, 'hunter' || (page_id + 1) || ' p@ss-w0rd!' || (page_id + 5) || '0 hunterp%40ss-w0rd!' || (page_id + 11) || ' ' || coalesce(html, '') AS message FROM pages),
x AS (SELECT page_id, list_reduce(list_concat([message], (SELECT list(secret ORDER BY length(secret) DESC, secret) FROM s)), lambda a, b: replace(a, b, '***')) AS message FROM m)
SELECT page_id, sha256(message) AS hash, length(message) AS n_chars FROM x""",
}
