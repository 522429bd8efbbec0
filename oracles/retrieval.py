"""Oracles of discovery, name resolution, detail and neighbour queries."""

from __future__ import annotations

from .base import qid
from .drift import TABLES as BASE
from .pages import clip, full, trim

# The texts the search queries look for.
TEXTS = ["  EMAIL ", "customer_id", "order_1", "sales.nation", "Mixed Case_3", "%", 'odd."1']
_TEXT_ROWS = ", ".join("('" + t + "')" for t in TEXTS)

P = r'"(?:[^"]|"")+"|[^."]+'
UNQUOTE = """CASE WHEN starts_with({x}, '"') THEN replace(substr({x}, 2, length({x}) - 2), '""', '"') ELSE translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"""


def parse(x: str) -> str:
    """One or two name parts, null when malformed."""
    t = trim(x)
    return (
        rf"""CASE WHEN regexp_full_match({t}, '(?s)({P})(\.({P}))?') THEN list_transform(regexp_extract_all({t}, '{P}'), lambda p: {UNQUOTE.format(x='p')}) END"""
    )


TABLES = BASE
TABLES.update({
    "texts": f"SELECT lower({trim('t')}) AS text FROM (VALUES {_TEXT_ROWS}) v(t)",
    "col_hit": """
SELECT c.catalog_id, c.snapshot_id, c.relation_id, t.text, min(CASE WHEN lower(c.name) = t.text THEN 1 ELSE 2 END) AS rank, string_agg(c.name, '|' ORDER BY c.ordinal) AS names
FROM live_col c JOIN texts t ON contains(lower(c.name), t.text) GROUP BY c.catalog_id, c.snapshot_id, c.relation_id, t.text""",
    "name_hit": """
SELECT r.catalog_id, r.snapshot_id, r.relation_id, t.text, CASE WHEN t.text IN (lower(r.name), lower(r.schema || '.' || r.name), lower(r.relation_id)) THEN 0 ELSE 2 END AS rank
FROM live_rel r JOIN texts t ON contains(lower(r.name), t.text) OR contains(lower(r.schema || '.' || r.name), t.text) OR contains(lower(r.relation_id), t.text)""",
    "found": """
SELECT coalesce(n.catalog_id, c.catalog_id) AS catalog_id, coalesce(n.snapshot_id, c.snapshot_id) AS snapshot_id, coalesce(n.relation_id, c.relation_id) AS relation_id, coalesce(n.text, c.text) AS text,
  CASE WHEN n.rank = 0 THEN 0 ELSE coalesce(c.rank, 2) END AS rank, coalesce(c.names, '') AS matched_columns
FROM name_hit n FULL JOIN col_hit c ON c.catalog_id = n.catalog_id AND c.relation_id = n.relation_id AND c.text = n.text""",
    "known": f"""
SELECT catalog_id, relation_id, name FROM live_rel
UNION ALL SELECT p.catalog_id, p.relation_id, ({parse('p.relation_id')})[-1] FROM note_pages p WHERE NOT EXISTS (SELECT 1 FROM live_rel r WHERE r.catalog_id = p.catalog_id AND r.relation_id = p.relation_id)""",
    "req": f"SELECT *, {parse('input')} AS parts FROM requests",
    "hit": f"""
SELECT q.catalog_id, q.request_id, q.pos, k.relation_id FROM (SELECT *, {qid('parts[1]', 'parts[2]')} AS id FROM req WHERE len(parts) = 2) q JOIN known k ON k.catalog_id = q.catalog_id AND k.relation_id = q.id
UNION ALL SELECT q.catalog_id, q.request_id, q.pos, k.relation_id FROM (SELECT r.*, {qid('s.schema', 'r.parts[1]')} AS id FROM req r JOIN live_scope s ON s.catalog_id = r.catalog_id WHERE len(r.parts) = 1) q
  JOIN known k ON k.catalog_id = q.catalog_id AND k.relation_id = q.id""",
    "resolved": """
SELECT r.catalog_id, r.request_id, r.pos, r.input, r.parts, CASE WHEN r.parts IS NULL THEN 'invalid_name' WHEN h.n = 1 THEN 'ok' WHEN h.n > 1 THEN 'ambiguous_name' ELSE 'unknown_relation' END AS code,
  CASE WHEN h.n = 1 THEN h.id END AS relation_id
FROM req r LEFT JOIN (SELECT catalog_id, request_id, pos, count(*) AS n, min(relation_id) AS id FROM hit GROUP BY catalog_id, request_id, pos) h
  ON h.catalog_id = r.catalog_id AND h.request_id = r.request_id AND h.pos = r.pos""",
    "asked": "SELECT catalog_id, request_id, relation_id, min(pos) AS pos FROM resolved WHERE code = 'ok' GROUP BY catalog_id, request_id, relation_id",
    "edge": """
SELECT f.catalog_id, f.relation_id AS a, f.ref AS b FROM live_fk f JOIN live_rel r ON r.catalog_id = f.catalog_id AND r.relation_id = f.ref
UNION SELECT f.catalog_id, f.ref, f.relation_id FROM live_fk f JOIN live_rel r ON r.catalog_id = f.catalog_id AND r.relation_id = f.ref""",
    "problem": """
SELECT catalog_id, request_id, pos, input, code FROM resolved WHERE code <> 'ok' QUALIFY row_number() OVER (PARTITION BY catalog_id, request_id ORDER BY pos) = 1
UNION ALL SELECT catalog_id, request_id, NULL, NULL, 'too_many_relations' FROM resolved GROUP BY catalog_id, request_id
HAVING count(DISTINCT relation_id) > 20 AND count(*) FILTER (code <> 'ok') = 0""",
    "own": "SELECT a.* FROM asked a WHERE NOT EXISTS (SELECT 1 FROM problem p WHERE p.catalog_id = a.catalog_id AND p.request_id = a.request_id)",
    "near": """
SELECT catalog_id, request_id, b, row_number() OVER (PARTITION BY catalog_id, request_id ORDER BY b) AS position FROM (
  SELECT DISTINCT o.catalog_id, o.request_id, e.b FROM own o JOIN edge e ON e.catalog_id = o.catalog_id AND e.a = o.relation_id
  WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.catalog_id = o.catalog_id AND x.request_id = o.request_id AND x.relation_id = e.b)) d""",
    "chosen": """
SELECT catalog_id, 's2' AS snapshot_id, request_id, relation_id, false AS is_neighbor, CAST(pos AS BIGINT) AS pos, CAST(0 AS BIGINT) AS omitted FROM own
UNION ALL SELECT catalog_id, 's2', request_id, b, true, position, 0 FROM near""",
    "picked": "SELECT catalog_id, relation_id, bool_and(is_neighbor) AS near FROM chosen GROUP BY catalog_id, relation_id",
    "degree": "SELECT catalog_id, a, b, row_number() OVER (PARTITION BY catalog_id, a ORDER BY b) AS position, count(*) OVER (PARTITION BY catalog_id, a) AS total FROM edge WHERE a <> b",
    "overview_rows": f"""
SELECT r.catalog_id, r.snapshot_id, r.relation_id, r.kind, coalesce(c.n, 0) AS columns, w.n AS warnings, {full('p.purpose')} AS full_purpose
FROM live_rel r LEFT JOIN (SELECT catalog_id, relation_id, count(*) AS n FROM live_col GROUP BY catalog_id, relation_id) c ON c.catalog_id = r.catalog_id AND c.relation_id = r.relation_id
LEFT JOIN (SELECT catalog_id, relation_id, count(*) AS n FROM (
    SELECT catalog_id, relation_id FROM warning w WHERE NOT (code = 'undocumented' AND EXISTS (SELECT 1 FROM page p WHERE p.catalog_id = w.catalog_id AND p.relation_id = w.relation_id AND NOT p.ok))
    UNION ALL SELECT catalog_id, relation_id FROM page_warning WHERE code IS NOT NULL) u GROUP BY catalog_id, relation_id) w ON w.catalog_id = r.catalog_id AND w.relation_id = r.relation_id
LEFT JOIN (SELECT * FROM page WHERE ok) p ON p.catalog_id = r.catalog_id AND p.relation_id = r.relation_id""",
    "overviewed": f"SELECT catalog_id, snapshot_id, relation_id, kind, columns, warnings, {clip('full_purpose', 120)} AS purpose, coalesce(length(full_purpose) > 120, false) AS truncated FROM overview_rows",
})

SQL = {
    "overview": "SELECT * FROM overviewed",
    "search": "SELECT * FROM found",
    "search_pages": """
SELECT catalog_id, snapshot_id, text, relation_id, rank, position, total, CAST((position - 1) // 50 AS INTEGER) AS page,
  CASE WHEN ((position - 1) // 50 + 1) * 50 < total THEN ((position - 1) // 50 + 1) * 50 END AS next_position
FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id, text ORDER BY rank, relation_id) AS position, count(*) OVER (PARTITION BY catalog_id, text) AS total FROM found) x""",
    "search_page": """
SELECT rank, relation_id, catalog_id FROM found WHERE text = 'order_1' AND (rank > 2 OR (rank = 2 AND (relation_id > 'finished.order_11' OR (relation_id = 'finished.order_11' AND catalog_id > 'db'))))
ORDER BY rank, relation_id, catalog_id LIMIT 50""",
    "resolve_names": "SELECT catalog_id, request_id, pos, input, code, relation_id FROM resolved",
    "name_candidates": """
SELECT r.catalog_id, r.request_id, r.pos, h.relation_id AS candidate FROM resolved r JOIN hit h ON h.catalog_id = r.catalog_id AND h.request_id = r.request_id AND h.pos = r.pos WHERE r.code = 'ambiguous_name'
UNION ALL SELECT r.catalog_id, r.request_id, r.pos, k.relation_id FROM resolved r JOIN known k ON k.catalog_id = r.catalog_id AND lower(k.name) = lower(r.parts[-1]) WHERE r.code = 'unknown_relation'""",
    "request_problems": "SELECT * FROM problem",
    "accepted_requests": "SELECT * FROM own",
    "neighbors": "SELECT catalog_id, 's2' AS snapshot_id, a AS request_id, position, b AS neighbor, CAST(0 AS BIGINT) AS omitted FROM degree",
    "capped_neighbors": "SELECT catalog_id, 's2' AS snapshot_id, a AS request_id, position, b AS neighbor, greatest(total - 20, 0) AS omitted FROM degree WHERE position <= 20",
    "detail_selection": "SELECT * FROM chosen",
    "detail": "SELECT l.* FROM all_lines l JOIN picked c ON c.catalog_id = l.catalog_id AND c.relation_id = l.relation_id",
    "detail_context": """
SELECT x.catalog_id, x.relation_id, x.field, x.item, sha256(x.value) AS value, x.truncated, x.pointer
FROM picked c JOIN context x ON x.catalog_id = c.catalog_id AND x.relation_id = c.relation_id WHERE NOT (c.near AND x.field = 'notes')""",
    "detail_entries": """
SELECT c.*, s.due_state AS state, s.path AS context_file, s.has_page AND NOT coalesce(s.ok, false) AND NOT c.is_neighbor AS partial
FROM chosen c LEFT JOIN subject s ON s.catalog_id = c.catalog_id AND s.relation_id = c.relation_id""",
    "detail_warnings": """
SELECT w.catalog_id, w.relation_id, w.source, w.check_no, w.code FROM (
  SELECT catalog_id, relation_id, 'rule' AS source, check_no, code FROM warning v
  WHERE NOT (code = 'undocumented' AND EXISTS (SELECT 1 FROM page p WHERE p.catalog_id = v.catalog_id AND p.relation_id = v.relation_id AND NOT p.ok))
  UNION ALL SELECT catalog_id, relation_id, 'page', check_no, code FROM page_warning WHERE code IS NOT NULL) w
JOIN picked c ON c.catalog_id = w.catalog_id AND c.relation_id = w.relation_id""",
    "detail_external": """
SELECT DISTINCT o.catalog_id, 's2' AS snapshot_id, o.request_id, f.ref FROM chosen o JOIN live_fk f ON f.catalog_id = o.catalog_id AND f.relation_id = o.relation_id
WHERE NOT EXISTS (SELECT 1 FROM live_rel r WHERE r.catalog_id = f.catalog_id AND r.relation_id = f.ref)""",
    "detail_enums": """
SELECT DISTINCT o.catalog_id, 's2' AS snapshot_id, o.request_id, e.enum_id, coalesce(array_to_string(e."values", '|'), '') AS "values", e.external FROM chosen o
JOIN live_col c ON c.catalog_id = o.catalog_id AND c.relation_id = o.relation_id JOIN enums e ON e.snapshot_id = 's2' AND e.catalog_id = c.catalog_id AND e.enum_id = c.enum_id""",
}
