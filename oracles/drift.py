"""Oracles of the comparison queries."""

from __future__ import annotations

from cartulary.keys import SECTIONS

from .pages import clean, clip
from .structure import TABLES as BASE

ON = "n.catalog_id = o.catalog_id AND n.relation_id = o.relation_id"
_SECTIONS = "concat_ws(',', " + ", ".join(f"CASE WHEN o.s_{s} <> n.s_{s} THEN '{s}' END" for s in SECTIONS) + ")"

TABLES = BASE
TABLES.update({
    "old_hash": "SELECT * FROM hashes WHERE snapshot_id = 's1'",
    "new_hash": "SELECT * FROM hashes WHERE snapshot_id = 's2'",
    "old_scoped": "SELECT * FROM old_hash WHERE (catalog_id, schema) IN (SELECT (catalog_id, schema) FROM live_scope)",
    "rdiff": f"""
SELECT coalesce(n.catalog_id, o.catalog_id) AS catalog_id, coalesce(n.relation_id, o.relation_id) AS relation_id,
  CASE WHEN o.hash IS NULL THEN 'relation_added' WHEN n.hash IS NULL THEN 'relation_removed' ELSE 'relation_changed' END AS code,
  CASE WHEN o.hash IS NOT NULL AND n.hash IS NOT NULL THEN {_SECTIONS} END AS sections
FROM old_scoped o FULL JOIN new_hash n ON {ON} WHERE o.hash IS DISTINCT FROM n.hash""",
    "cdiff": """
SELECT n.catalog_id, n.relation_id, string_agg(n.name, ',' ORDER BY n.ordinal) AS columns FROM live_col n
JOIN col o ON o.snapshot_id = 's1' AND o.catalog_id = n.catalog_id AND o.relation_id = n.relation_id AND o.name = n.name
JOIN old_scoped s ON s.catalog_id = n.catalog_id AND s.relation_id = n.relation_id
WHERE o.comment IS DISTINCT FROM n.comment GROUP BY n.catalog_id, n.relation_id""",
    "tdiff": """
SELECT n.catalog_id, n.relation_id FROM live_rel n JOIN rel o ON o.snapshot_id = 's1' AND o.catalog_id = n.catalog_id AND o.relation_id = n.relation_id
JOIN old_scoped s ON s.catalog_id = n.catalog_id AND s.relation_id = n.relation_id WHERE o.comment IS DISTINCT FROM n.comment""",
    "ddiff": """
SELECT coalesce(t.catalog_id, c.catalog_id) AS catalog_id, coalesce(t.relation_id, c.relation_id) AS relation_id, 'relation_documentation_changed' AS code,
  t.relation_id IS NOT NULL AS table_changed, c.columns FROM tdiff t FULL JOIN cdiff c ON c.catalog_id = t.catalog_id AND c.relation_id = t.relation_id""",
    "ediff": """
SELECT coalesce(n.catalog_id, o.catalog_id) AS catalog_id, coalesce(n.enum_id, o.enum_id) AS enum_id,
  CASE WHEN o.hash IS NULL THEN 'enum_added' WHEN n.hash IS NULL THEN 'enum_removed' ELSE 'enum_changed' END AS code
FROM (SELECT * FROM enum_hash WHERE snapshot_id = 's1') o FULL JOIN (SELECT * FROM enum_hash WHERE snapshot_id = 's2') n ON n.catalog_id = o.catalog_id AND n.enum_id = o.enum_id
WHERE o.hash IS DISTINCT FROM n.hash AND (n.hash IS NOT NULL OR o.external OR (o.catalog_id, o.schema) IN (SELECT (catalog_id, schema) FROM live_scope))""",
    "fresh": """
SELECT coalesce(n.catalog_id, o.catalog_id) AS catalog_id, coalesce(n.relation_id, o.relation_id) AS relation_id, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old_hash o FULL JOIN new_hash n ON n.catalog_id = o.catalog_id AND n.relation_id = o.relation_id WHERE o.hash IS DISTINCT FROM n.hash""",
    "mismatch": """
SELECT o.catalog_id, array_to_string(o.schemas, '|') AS stored, array_to_string(n.schemas, '|') AS configured
FROM (SELECT * FROM scope_list WHERE snapshot_id = 's1') o JOIN (SELECT * FROM scope_list WHERE snapshot_id = 's2') n ON n.catalog_id = o.catalog_id WHERE n.schemas <> o.schemas""",
    "report": f"""
SELECT catalog_id, 0 AS check_no, 'finding' AS severity, 'scope_changed' AS code, NULL AS target, NULL AS file, NULL AS "column", replace(configured, '|', ',') AS columns, replace(stored, '|', ',') AS sections,
  CAST(NULL AS BOOLEAN) AS table_changed, NULL AS page_state, NULL AS reason FROM mismatch
UNION ALL SELECT catalog_id, 1, 'finding', code, relation_id, NULL, NULL, NULL, sections, NULL, NULL, NULL FROM rdiff
UNION ALL SELECT catalog_id, 2, 'finding', code, relation_id, NULL, NULL, columns, NULL, CASE WHEN table_changed THEN true END, NULL, NULL FROM ddiff
UNION ALL SELECT catalog_id, 3, 'finding', code, enum_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ediff
UNION ALL SELECT catalog_id, 4, CASE code WHEN 'page_invalid' THEN 'error' WHEN 'page_archived' THEN 'archived' ELSE 'finding' END, code, relation_id, file, NULL, NULL, NULL, NULL,
  CASE WHEN code IN ('page_archived_but_present', 'page_archived') THEN state END, CASE WHEN code = 'page_invalid' THEN reason END FROM page_check
UNION ALL SELECT w.catalog_id, 5, CASE w.code WHEN 'stale_note' THEN 'finding' ELSE 'advisory' END, w.code, w.relation_id, CASE WHEN w.code = 'stale_note' THEN s.path END,
  CASE WHEN w.code = 'stale_note' THEN {clip(clean('w.columns[1]'), 500)} END, CASE WHEN w.code = 'fk_without_index' THEN array_to_string(w.columns, ',') END, NULL, NULL, NULL, NULL
  FROM warning w JOIN subject s ON s.catalog_id = w.catalog_id AND s.relation_id = w.relation_id WHERE s.captured AND s.has_page AND s.ok
UNION ALL SELECT c.catalog_id, 6, CASE f.file WHEN 'index.md' THEN 'finding' ELSE 'advisory' END, replace(f.file, '.md', '_missing'), NULL, f.file, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT DISTINCT catalog_id FROM live_scope) c CROSS JOIN (VALUES ('index.md'), ('rules.md'), ('log.md')) f(file) WHERE (c.catalog_id, f.file) NOT IN (SELECT (catalog_id, file) FROM artifacts)""",
    "summary": """
SELECT s.catalog_id, s.relations, s.enums, coalesce(f.added, 0) AS added, coalesce(f.changed, 0) AS changed, coalesce(f.removed, 0) AS removed,
  coalesce(p.c, 0) AS pages_created, coalesce(p.u, 0) AS pages_updated, coalesce(p.a, 0) AS pages_reactivated, coalesce(p.r, 0) AS pages_removed, coalesce(p.o, 0) AS pages_out_of_scope,
  coalesce(p.s, 0) AS pages_skipped, coalesce(p.n, 0) AS pages_unchanged, coalesce(d.n, 0) AS undocumented
FROM (SELECT * FROM snap WHERE snapshot_id = 's2') s
LEFT JOIN (SELECT catalog_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed FROM fresh GROUP BY catalog_id) f ON f.catalog_id = s.catalog_id
LEFT JOIN (SELECT catalog_id, count(*) FILTER (action = 'created') AS c, count(*) FILTER (action = 'updated') AS u, count(*) FILTER (action = 'reactivated') AS a, count(*) FILTER (action = 'removed') AS r,
  count(*) FILTER (action = 'out_of_scope') AS o, count(*) FILTER (action = 'skipped') AS s, count(*) FILTER (action = 'unchanged') AS n FROM life GROUP BY catalog_id) p ON p.catalog_id = s.catalog_id
LEFT JOIN (SELECT catalog_id, count(*) FILTER (undocumented) AS n FROM documented GROUP BY catalog_id) d ON d.catalog_id = s.catalog_id""",
})

SQL = {
    "snapshot_diff": "SELECT * FROM rdiff",
    "documentation_diff": "SELECT * FROM ddiff",
    "enum_diff": "SELECT * FROM ediff",
    "refresh_diff": "SELECT * FROM fresh",
    "hash_history": """
SELECT catalog_id, relation_id, snapshot_id, CASE WHEN p IS NULL THEN 'first' WHEN p <> hash THEN 'changed' ELSE 'same' END AS change
FROM (SELECT *, lag(hash) OVER (PARTITION BY catalog_id, relation_id ORDER BY snapshot_id) AS p FROM hashes) x""",
    "scope_mismatch": "SELECT * FROM mismatch",
    "drift": "SELECT * FROM report",
    "drift_verdicts": """
SELECT c.catalog_id, coalesce(e, 0) AS error_count, coalesce(f, 0) AS finding_count, coalesce(a, 0) AS archived_count, coalesce(d, 0) AS advisory_count,
  CASE WHEN coalesce(e, 0) > 0 THEN 2 WHEN coalesce(f, 0) > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN coalesce(e, 0) > 0 THEN 'error' WHEN coalesce(f, 0) > 0 THEN 'out_of_sync' ELSE 'synchronized' END AS result
FROM (SELECT DISTINCT catalog_id FROM live_scope) c LEFT JOIN (SELECT catalog_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'finding') AS f,
  count(*) FILTER (severity = 'archived') AS a, count(*) FILTER (severity = 'advisory') AS d FROM report GROUP BY catalog_id) r ON r.catalog_id = c.catalog_id""",
    "refresh_summary": "SELECT * FROM summary",
    "run_log": """
SELECT catalog_id, '2026-09-25T10:30:00Z capture: ' || relations || ' relations, ' || enums || ' enums; pages: ' || pages_created || ' new, ' || (pages_updated + pages_reactivated) || ' changed, '
  || pages_removed || ' removed, ' || pages_out_of_scope || ' out of scope, ' || pages_skipped || ' skipped' AS line FROM summary""",
    "snapshot_checks": """
SELECT catalog_id, snapshot_id, c AS "check", CASE WHEN c = 'revision' THEN right(catalog_id, 1) <> '7' OR revision = reverse(revision) ELSE true END AS ok
FROM (SELECT *, unnest(['format', 'coverage', 'schemas', 'relations', 'enums', 'revision']) AS c FROM snap) x""",
}
