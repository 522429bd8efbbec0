"""Oracles of the capture queries."""

from .base import KEY

SQL = {
    "scan_relations": "SELECT catalog_id, snapshot_id, relation_id, schema, name, kind, row_estimate, comment, view_definition, partition_key FROM rel",
    "scan_columns": 'SELECT catalog_id, snapshot_id, relation_id, ordinal, name, type, nullable, "default", identity, generated, comment, enum_id FROM col',
    "scan_constraints": "SELECT catalog_id, snapshot_id, relation_id, name, ctype, array_to_string(columns, '|') AS columns, definition FROM con",
    "scan_foreign_keys": "SELECT * REPLACE (array_to_string(columns, '|') AS columns, array_to_string(ref_columns, '|') AS ref_columns) FROM fk",
    "scan_indexes": """SELECT * REPLACE (array_to_string(list_transform(keys, lambda k: coalesce(k."column", '=' || k.expression)), '|') AS keys, coalesce(array_to_string(include, '|'), '') AS include) FROM idx""",
    "scan_enums": """SELECT * REPLACE (coalesce(array_to_string("values", '|'), '') AS "values") FROM enums""",
    "inverse_references": """
SELECT f.catalog_id, f.snapshot_id, f.ref AS relation_id, f.relation_id AS from_relation, f.name, array_to_string(f.columns, '|') AS columns, array_to_string(f.ref_columns, '|') AS ref_columns
FROM fk f WHERE (f.catalog_id, f.snapshot_id, f.ref) IN (SELECT (catalog_id, snapshot_id, relation_id) FROM rel)""",
    "external_targets": f"""
SELECT DISTINCT f.catalog_id, f.snapshot_id, f.relation_id, f.ref FROM fk f LEFT JOIN rel r ON r.catalog_id = f.catalog_id AND r.snapshot_id = f.snapshot_id AND r.relation_id = f.ref
WHERE r.relation_id IS NULL""",
    "relation_hashes": "SELECT * FROM hashes",
    "enum_hashes": f"SELECT {KEY}, enum_id, external, hash FROM enum_hash",
    "snapshot_revisions": "SELECT * REPLACE (array_to_string(schemas, '|') AS schemas) FROM snap",
}
