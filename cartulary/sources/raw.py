"""Readers of raw catalog extracts.

An extract is a folder of Parquet tables shaped like the server's catalog,
each with ``catalog_id`` and ``snapshot_id``. One extract run must come from
one database transaction, so that all its tables show the same point in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_KEY = "catalog_id string, snapshot_id string, "
SCHEMAS = {
    "scopes": _KEY + "schema string, position int",
    "namespaces": _KEY + "oid bigint, nspname string",
    "relations": _KEY + "oid bigint, relnamespace bigint, relname string, relkind string, reltuples double, comment string, "
    "view_definition string, partition_key string, relispartition boolean",
    "attributes": _KEY + "attrelid bigint, attnum int, attname string, atttypid bigint, type_text string, attnotnull boolean, "
    "attgenerated string, expr string, attidentity string, comment string, attisdropped boolean",
    "types": _KEY + "oid bigint, typnamespace bigint, typname string, typtype string, typcategory string, typelem bigint",
    "enum_labels": _KEY + "enumtypid bigint, enumsortorder double, enumlabel string",
    "constraints": _KEY + "conname string, conrelid bigint, contype string, conkey array<int>, confrelid bigint, confkey array<int>, "
    "confdeltype string, confupdtype string, confmatchtype string, condeferrable boolean, condeferred boolean, convalidated boolean, "
    "conindid bigint, conparentid bigint, definition string",
    "indexes": _KEY + "indexrelid bigint, indrelid bigint, relname string, amname string, indisunique boolean, indisprimary boolean, "
    "indisvalid boolean, indnkeyatts int, indkey array<int>, key_defs array<string>, predicate string, definition string",
}


def read_raw(spark: SparkSession, path: str, snapshot_id: str | None = None) -> dict[str, DataFrame]:
    """All extract tables below ``path``, optionally of one snapshot (pruned by partition)."""
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
    if snapshot_id is not None:
        tables = {name: frame.filter(F.col("snapshot_id") == snapshot_id) for name, frame in tables.items()}
    return tables


def scope_list(spark: SparkSession, schemas: list[str] | None, catalog_id: str, snapshot_id: str) -> DataFrame:
    """The configured schemas of one catalog, in order; ``public`` when none are given."""
    listed = ["public"] if schemas is None else schemas
    if not listed or any(not isinstance(s, str) or s == "" or "\0" in s for s in listed):
        raise ValueError("schemas must be a non-empty list of schema names")
    if len(set(listed)) != len(listed):
        raise ValueError("schemas contains duplicates")
    rows = [(catalog_id, snapshot_id, schema, number) for number, schema in enumerate(listed, 1)]
    return spark.createDataFrame(rows, SCHEMAS["scopes"])


def checked_scopes(scopes: DataFrame, catalogs: DataFrame) -> DataFrame:
    """``catalog_id, snapshot_id, schemas, flaw``: the configured schemas of every catalog in order, ``public`` where none are given.

    ``flaw`` tells lists that cannot be used: an empty name, or one that is there twice.
    """
    key = ["catalog_id", "snapshot_id"]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("schema", F.lit("")).alias("schema")))), lambda s: s["schema"])
    lists = scopes.groupBy(*key).agg(ordered.alias("listed"))
    listed = F.coalesce("listed", F.array(F.lit("public")))
    empty = F.exists("schemas", lambda s: (s == "") | F.contains(s, F.lit("\0")))
    return catalogs.select(*key).distinct().join(lists, key, "left").select(*key, listed.alias("schemas")).withColumn(
        "flaw", F.when(empty, "empty_name").when(F.size(F.array_distinct("schemas")) < F.size("schemas"), "repeated_name"))
