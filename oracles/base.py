"""Common table expressions: raw extracts and snapshot tables in plain SQL."""

from __future__ import annotations

import re

from cartulary.keys import COVERAGE, FORMAT, SECTIONS, SENSITIVE_PATTERNS
from cartulary.sources.derived import STATEMENTS, dialect

KEY = "catalog_id, snapshot_id"


def enc(x: str) -> str:
    return f"coalesce(length(CAST({x} AS string)) || ':' || CAST({x} AS string), '~')"


def enc_list(x: str) -> str:
    body = f"coalesce(array_to_string(list_transform({x}, lambda e: {enc('e')}), ''), '')"
    return f"coalesce('[' || len({x}) || ']' || {body}, '~')"


def cat(*parts: str) -> str:
    return " || ".join(parts)


def lanes(h: str) -> str:
    sums = [f"coalesce(CAST(sum(CAST('0x' || substr({h}, {1 + 7 * i}, 7) AS BIGINT)) AS BIGINT), 0)" for i in range(9)]
    return "sha256(" + " || ',' || ".join([f"count({h})"] + sums) + ")"


EMPTY = "sha256('0,0,0,0,0,0,0,0,0,0')"


def quote(x: str) -> str:
    return f"""CASE WHEN regexp_full_match({x}, '[a-z_][a-z0-9_]*') THEN {x} ELSE '"' || replace({x}, '"', '""') || '"' END"""


def qid(s: str, n: str) -> str:
    return f"({quote(s)}) || '.' || ({quote(n)})"


def code(x: str, values: dict[str, str], fallback: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {fallback} END"


ACTION = {"a": "no action", "r": "restrict", "c": "cascade", "n": "set null", "d": "set default"}

_RAW = {
    f"raw_{name}": re.sub(
        r"\{(\w+)\}", lambda m: f"raw_{m[1]}" if m[1] in STATEMENTS else m[1],
        dialect(text, "list_value", "unnest", "CAST(NULL AS INTEGER[])"),
    )
    for name, text in STATEMENTS.items()
}

def _key_names(table: str, rel: str, arr: str, rid: str) -> str:
    return (
        f"SELECT x.catalog_id, x.snapshot_id, x.relid, x.row_id, list(a.attname ORDER BY x.pos) AS names FROM ("
        f"SELECT catalog_id, snapshot_id, {rel} AS relid, {rid} AS row_id, unnest({arr}) AS attnum, unnest(range(1, len({arr}) + 1)) AS pos FROM {table}) x "
        "JOIN raw_attributes a ON a.catalog_id = x.catalog_id AND a.snapshot_id = x.snapshot_id AND a.attrelid = x.relid AND a.attnum = x.attnum "
        "GROUP BY x.catalog_id, x.snapshot_id, x.relid, x.row_id"
    )


_SNAP = {
    "rel": f"""
SELECT r.catalog_id, r.snapshot_id, r.oid, {qid('n.nspname', 'r.relname')} AS relation_id, n.nspname AS schema, r.relname AS name,
  {code('r.relkind', {'r': 'table', 'p': 'partitioned_table', 'v': 'view', 'm': 'materialized_view'})} AS kind,
  CASE WHEN r.relkind <> 'v' AND NOT isnan(r.reltuples) AND r.reltuples >= 0 THEN CAST(floor(r.reltuples + 0.5) AS BIGINT) END AS row_estimate,
  r.comment, CASE WHEN r.relkind IN ('v', 'm') THEN r.view_definition END AS view_definition, CASE WHEN r.relkind = 'p' THEN r.partition_key END AS partition_key
FROM raw_relations r JOIN raw_namespaces n ON n.catalog_id = r.catalog_id AND n.snapshot_id = r.snapshot_id AND n.oid = r.relnamespace
WHERE r.relkind IN ('r', 'p', 'v', 'm') AND NOT r.relispartition
  AND (r.catalog_id, r.snapshot_id, n.nspname) IN (SELECT (catalog_id, snapshot_id, schema) FROM raw_scopes)""",
    "enum_type": f"""
SELECT t.catalog_id, t.snapshot_id, t.oid, n.nspname AS schema, t.typname AS name, {qid('n.nspname', 't.typname')} AS enum_id
FROM raw_types t JOIN raw_namespaces n ON n.catalog_id = t.catalog_id AND n.snapshot_id = t.snapshot_id AND n.oid = t.typnamespace WHERE t.typtype = 'e'""",
    "col": f"""
SELECT a.catalog_id, a.snapshot_id, r.relation_id,
  CAST(row_number() OVER (PARTITION BY a.catalog_id, a.snapshot_id, a.attrelid ORDER BY a.attnum) AS INTEGER) AS ordinal,
  a.attname AS name, a.type_text AS type, NOT a.attnotnull AS nullable, CASE WHEN a.attgenerated = '' THEN a.expr END AS "default",
  {code('a.attidentity', {'a': 'always', 'd': 'by_default'})} AS identity, CASE WHEN a.attgenerated <> '' THEN a.expr END AS generated,
  a.comment, coalesce(e1.enum_id, e2.enum_id) AS enum_id
FROM raw_attributes a JOIN rel r ON r.catalog_id = a.catalog_id AND r.snapshot_id = a.snapshot_id AND r.oid = a.attrelid
JOIN raw_types t ON t.catalog_id = a.catalog_id AND t.snapshot_id = a.snapshot_id AND t.oid = a.atttypid
LEFT JOIN raw_types et ON et.catalog_id = t.catalog_id AND et.snapshot_id = t.snapshot_id AND et.oid = t.typelem AND t.typcategory = 'A'
LEFT JOIN enum_type e1 ON e1.catalog_id = t.catalog_id AND e1.snapshot_id = t.snapshot_id AND e1.oid = t.oid
LEFT JOIN enum_type e2 ON e2.catalog_id = t.catalog_id AND e2.snapshot_id = t.snapshot_id AND e2.oid = et.oid
WHERE a.attnum > 0 AND NOT a.attisdropped""",
    "raw_con": "SELECT *, row_number() OVER () AS row_id FROM raw_constraints WHERE conparentid = 0",
    "con_names": _key_names("raw_con", "conrelid", "conkey", "row_id"),
    "ref_names": _key_names("(SELECT * FROM raw_con WHERE contype = 'f') f", "confrelid", "confkey", "row_id"),
    "con": """
SELECT c.catalog_id, c.snapshot_id, r.relation_id, c.conname AS name, c.contype AS ctype, k.names AS columns, c.definition, c.conindid AS index_oid
FROM raw_con c JOIN rel r ON r.catalog_id = c.catalog_id AND r.snapshot_id = c.snapshot_id AND r.oid = c.conrelid
LEFT JOIN con_names k ON k.row_id = c.row_id WHERE c.contype IN ('p', 'u', 'c')""",
    "fk": f"""
SELECT c.catalog_id, c.snapshot_id, r.relation_id, c.conname AS name, k.names AS columns, tn.nspname AS ref_schema, t.relname AS ref_name,
  {qid('tn.nspname', 't.relname')} AS ref, rk.names AS ref_columns,
  {code('c.confdeltype', ACTION, "'no action'")} AS on_delete, {code('c.confupdtype', ACTION, "'no action'")} AS on_update,
  {code('c.confmatchtype', {'s': 'simple', 'f': 'full', 'p': 'partial'}, "'simple'")} AS "match", c.condeferrable AS "deferrable",
  c.condeferred AS initially_deferred, c.convalidated AS validated, c.definition
FROM raw_con c JOIN rel r ON r.catalog_id = c.catalog_id AND r.snapshot_id = c.snapshot_id AND r.oid = c.conrelid
LEFT JOIN con_names k ON k.row_id = c.row_id LEFT JOIN ref_names rk ON rk.row_id = c.row_id
LEFT JOIN raw_relations t ON t.catalog_id = c.catalog_id AND t.snapshot_id = c.snapshot_id AND t.oid = c.confrelid
LEFT JOIN raw_namespaces tn ON tn.catalog_id = t.catalog_id AND tn.snapshot_id = t.snapshot_id AND tn.oid = t.relnamespace
WHERE c.contype = 'f'""",
    "idx_pos": """
SELECT x.*, a.attname FROM (SELECT *, unnest(indkey) AS attnum, unnest(range(1, len(indkey) + 1)) AS pos FROM raw_indexes) x
LEFT JOIN raw_attributes a ON a.catalog_id = x.catalog_id AND a.snapshot_id = x.snapshot_id AND a.attrelid = x.indrelid AND a.attnum = x.attnum""",
    # All fields of an index are carried along: one join less, whose order the planner got wrong.
    "idx_keys": """
SELECT catalog_id, snapshot_id, indexrelid, any_value(indrelid) AS indrelid, any_value(relname) AS relname, any_value(amname) AS amname, any_value(indisunique) AS indisunique,
  any_value(indisprimary) AS indisprimary, any_value(indisvalid) AS indisvalid, any_value(predicate) AS predicate, any_value(definition) AS definition,
  list(struct_pack("column" := attname, expression := CASE WHEN attname IS NULL THEN key_defs[pos] END) ORDER BY pos) FILTER (pos <= indnkeyatts) AS keys,
  coalesce(list(attname ORDER BY pos) FILTER (pos > indnkeyatts), CAST([] AS VARCHAR[])) AS include
FROM idx_pos GROUP BY catalog_id, snapshot_id, indexrelid""",
    # The constraint that an index stands for, by numbers only: nothing else of the constraints is worked out.
    "idx_con": """
SELECT c.catalog_id, c.snapshot_id, c.conrelid, c.conindid, c.conname FROM raw_constraints c WHERE c.conparentid = 0 AND c.contype IN ('p', 'u') AND c.conindid <> 0""",
    "idx": """
SELECT i.catalog_id, i.snapshot_id, r.relation_id, i.relname AS name, i.amname AS method, i.keys, i.include, i.indisunique AS is_unique,
  i.indisprimary AS is_primary, i.indisvalid AS valid, i.predicate, c.conname AS constraint_name, i.definition
FROM idx_keys i JOIN rel r ON r.catalog_id = i.catalog_id AND r.snapshot_id = i.snapshot_id AND r.oid = i.indrelid
LEFT JOIN idx_con c ON c.catalog_id = i.catalog_id AND c.snapshot_id = i.snapshot_id AND c.conrelid = i.indrelid AND c.conindid = i.indexrelid""",
    "enums": """
SELECT t.catalog_id, t.snapshot_id, t.enum_id, t.schema, t.name,
  coalesce((SELECT list(l.enumlabel ORDER BY l.enumsortorder) FROM raw_enum_labels l WHERE l.catalog_id = t.catalog_id AND l.snapshot_id = t.snapshot_id AND l.enumtypid = t.oid), CAST([] AS VARCHAR[])) AS "values",
  s.schema IS NULL AS external
FROM enum_type t LEFT JOIN raw_scopes s ON s.catalog_id = t.catalog_id AND s.snapshot_id = t.snapshot_id AND s.schema = t.schema
WHERE s.schema IS NOT NULL OR (t.catalog_id, t.snapshot_id, t.enum_id) IN (SELECT (catalog_id, snapshot_id, enum_id) FROM col WHERE enum_id IS NOT NULL)""",
    "rows_hashed": f"""
SELECT {KEY}, relation_id, 'columns' AS section, sha256({cat(*[enc(c) for c in ('ordinal', 'name', 'type', 'nullable', '"default"', 'identity', 'generated')])}) AS h FROM col
UNION ALL SELECT {KEY}, relation_id, 'documentation', sha256({cat(enc('ordinal'), enc('name'), enc('comment'))}) FROM col
UNION ALL SELECT {KEY}, relation_id, CASE ctype WHEN 'p' THEN 'primaryKey' WHEN 'u' THEN 'uniques' ELSE 'checks' END, sha256({cat(enc('name'), enc_list('columns'), enc('definition'))}) FROM con
UNION ALL SELECT {KEY}, relation_id, 'foreignKeys', sha256({cat(enc('name'), enc_list('columns'), enc('ref_schema'), enc('ref_name'), enc_list('ref_columns'), *[enc(c) for c in ('on_delete', 'on_update', '"match"', '"deferrable"', 'initially_deferred', 'validated', 'definition')])}) FROM fk
UNION ALL SELECT {KEY}, relation_id, 'indexes', sha256({cat(enc('name'), enc('method'), f"'[' || len(keys) || ']' || array_to_string(list_transform(keys, lambda k: {enc('k.column')} || {enc('k.expression')}), '')", enc_list('include'), *[enc(c) for c in ('is_unique', 'is_primary', 'valid', 'predicate', 'definition')])}) FROM idx
UNION ALL SELECT c.catalog_id, c.snapshot_id, c.relation_id, 'enums', sha256({cat(enc('e.schema'), enc('e.name'), enc_list('e."values"'))})
  FROM (SELECT DISTINCT {KEY}, relation_id, enum_id FROM col WHERE enum_id IS NOT NULL) c
  JOIN enums e ON e.catalog_id = c.catalog_id AND e.snapshot_id = c.snapshot_id AND e.enum_id = c.enum_id""",
    "section_hash": f"SELECT {KEY}, relation_id, section, {lanes('h')} AS h FROM rows_hashed GROUP BY {KEY}, relation_id, section",
    "wide": f"SELECT {KEY}, relation_id, "
    + ", ".join(f"max(CASE WHEN section = '{s}' THEN h END) AS h_{s}" for s in ("columns", "primaryKey", "uniques", "checks", "foreignKeys", "indexes", "enums", "documentation"))
    + f" FROM section_hash GROUP BY {KEY}, relation_id",
    "sectioned": "SELECT r.catalog_id, r.snapshot_id, r.relation_id, r.schema, r.comment, "
    + ", ".join(
        f"sha256({enc('r.' + {'kind': 'kind', 'view': 'view_definition', 'partitionKey': 'partition_key'}[s])}) AS s_{s}"
        if s in ("kind", "view", "partitionKey") else f"coalesce(w.h_{s}, {EMPTY}) AS s_{s}"
        for s in SECTIONS
    )
    + f", coalesce(w.h_documentation, {EMPTY}) AS h_documentation FROM rel r LEFT JOIN wide w ON w.catalog_id = r.catalog_id AND w.snapshot_id = r.snapshot_id AND w.relation_id = r.relation_id",
    "hashes": "SELECT catalog_id, snapshot_id, relation_id, schema, " + ", ".join(f"s_{s}" for s in SECTIONS)
    + f", hash, sha256(hash || {enc('comment')} || h_documentation) AS doc_hash FROM (SELECT *, sha256("
    + " || ".join(f"s_{s}" for s in SECTIONS) + ") AS hash FROM sectioned) x",
    "scope_list": f"SELECT {KEY}, list(schema ORDER BY position) AS schemas FROM raw_scopes GROUP BY {KEY}",
    "enum_hash": f"""SELECT {KEY}, enum_id, schema, external, sha256({cat(enc('schema'), enc('name'), enc_list('"values"'))}) AS hash FROM enums""",
    "snap": f"""
SELECT s.catalog_id, s.snapshot_id, s.schemas, coalesce(r.n, 0) AS relations, coalesce(e.n, 0) AS enums,
  sha256({cat(enc(str(FORMAT)), enc(f"'{COVERAGE}'"), enc_list('s.schemas'), f"coalesce(r.h, {EMPTY})", f"coalesce(e.h, {EMPTY})")}) AS revision
FROM scope_list s
LEFT JOIN (SELECT {KEY}, count(*) AS n, {lanes('h')} AS h FROM (SELECT {KEY}, sha256({enc('relation_id')} || hash || doc_hash) AS h FROM hashes) x GROUP BY {KEY}) r
  ON r.catalog_id = s.catalog_id AND r.snapshot_id = s.snapshot_id
LEFT JOIN (SELECT {KEY}, count(*) AS n, {lanes('h')} AS h FROM (SELECT {KEY}, sha256({enc('enum_id')} || hash || {enc('external')}) AS h FROM enum_hash) x GROUP BY {KEY}) e
  ON e.catalog_id = s.catalog_id AND e.snapshot_id = s.snapshot_id""",
}


def sensitive(name: str) -> str:
    """Pattern with most parts, first listed on ties."""
    ranked = sorted(enumerate(SENSITIVE_PATTERNS), key=lambda p: (-len(p[1].split("_")), p[0]))
    return "CASE " + " ".join(f"WHEN contains('_' || lower({name}) || '_', '_{p}_') THEN '{p}'" for _, p in ranked) + " END"


TABLES = {**_RAW, **_SNAP}


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind exactly the common table expressions it needs."""
    tables = {**TABLES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in tables:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                needed.append(name)
                visit(tables[name])

    visit(body)
    if not needed:
        return body
    ordered = [name for name in tables if name in needed]
    # Each is worked out once, however often it is read.
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({tables[name].strip()})" for name in ordered) + "\n" + body.strip()
