"""Small snapshots as DataFrames, with defaults like the survey's synthetic builders."""

from __future__ import annotations

from cartulary.operators.hashes import relation_hashes, revisions
from cartulary.operators.references import referenced_by

KEY = "catalog_id string, snapshot_id string, "
SCHEMAS = {
    "scopes": KEY + "schema string, position int",
    "relations": KEY + "relation_id string, schema string, name string, kind string, row_estimate bigint, comment string, view_definition string, partition_key string",
    "columns": KEY + "relation_id string, ordinal int, name string, type string, nullable boolean, default string, identity string, generated string, comment string, enum_id string",
    "constraints": KEY + "relation_id string, name string, ctype string, columns array<string>, definition string",
    "foreign_keys": KEY + "relation_id string, name string, columns array<string>, ref_schema string, ref_name string, ref string, ref_columns array<string>, "
    "on_delete string, on_update string, match string, deferrable boolean, initially_deferred boolean, validated boolean, definition string",
    "indexes": KEY + "relation_id string, name string, method string, keys array<struct<column: string, expression: string>>, include array<string>, "
    "is_unique boolean, is_primary boolean, valid boolean, predicate string, constraint_name string, definition string",
    "enums": KEY + "enum_id string, schema string, name string, values array<string>, external boolean",
}


def relation(name, schema="public", kind="table", rows=None, comment=None, view=None, partition=None):
    return (f"{schema}.{name}", schema, name, kind, rows, comment, view, partition)


def column(rel, ordinal, name, type="text", nullable=True, default=None, identity=None, generated=None, comment=None, enum=None):
    return (f"public.{rel}" if "." not in rel else rel, ordinal, name, type, nullable, default, identity, generated, comment, enum)


def foreign_key(rel, columns, ref="public.parent", name=None, definition=""):
    schema, target = ref.split(".")
    return (f"public.{rel}" if "." not in rel else rel, name or "fk_" + "_".join(columns), columns, schema, target, ref, ["id"] * len(columns),
            "no action", "no action", "simple", False, False, True, definition)


def index(rel, name, keys, include=(), valid=True, predicate=None, method="btree", constraint=None):
    parts = [k if isinstance(k, tuple) else (k, None) for k in keys]
    return (f"public.{rel}", name, method, parts, list(include), False, False, valid, predicate, constraint, f"CREATE INDEX {name}")


def snapshots(spark, catalogs, snapshot_id="s1"):
    """All snapshot tables of several catalogs at once; rows are given without the key columns."""
    filled = {
        catalog: {**tables, "scopes": [(s, i) for i, s in enumerate(tables.get("scopes", ("public",)), 1)]} for catalog, tables in catalogs.items()}
    made = {
        name: spark.createDataFrame([(c, snapshot_id, *row) for c, tables in filled.items() for row in tables.get(name, [])], schema)
        for name, schema in SCHEMAS.items()
    }
    made["referenced_by"] = referenced_by(made["foreign_keys"], made["relations"])
    made["hashes"] = relation_hashes(made)
    made["snapshots"] = revisions(made["hashes"], made["enums"], made["scopes"])
    return made


def snapshot(spark, snapshot_id="s1", scopes=("public",), catalog="c", **tables):
    return snapshots(spark, {catalog: {**tables, "scopes": scopes}}, snapshot_id)
