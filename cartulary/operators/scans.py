"""From raw catalog extracts to the snapshot tables.

All joins carry ``(catalog_id, snapshot_id)``, so one job decodes any number
of databases and points in time. Only groups that the server itself bounds
are collected into arrays: columns of one relation (at most 1,600), key
columns of one constraint or index, labels of one enum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.idents import qualified_id
from ..keys import ACTIONS, IDENTITIES, KINDS, MATCHES, SNAPSHOT
from ..session import small

Raw = dict[str, DataFrame]


def decode(code: Column, values: dict[str, str], fallback: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(pairs, code)
    return found if fallback is None else F.coalesce(found, F.lit(fallback))


def ordered_list(order: Column, value: Column) -> Column:
    """Aggregate: values by position; nulls stay because they sit inside the struct."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda pair: pair["v"])


def row_estimate(kind_code: Column, tuples: Column) -> Column:
    """Rounded half up; null for views and for anything not >= 0 (NaN >= 0 is true in Spark)."""
    known = (kind_code != "v") & ~F.isnan(tuples) & (tuples >= 0)
    return F.when(known, F.floor(tuples + 0.5))


def scan_relations(raw: Raw) -> DataFrame:
    """Relations of the configured schemas, without partition children."""
    r, n = raw["relations"], raw["namespaces"]
    named = (
        r.filter(F.col("relkind").isin(list(KINDS)) & ~F.col("relispartition"))
        .join(n.select(*SNAPSHOT, F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema")),
              SNAPSHOT + ["relnamespace"])
        .join(raw["scopes"].select(*SNAPSHOT, "schema"), SNAPSHOT + ["schema"], "left_semi")
    )
    return named.select(
        *SNAPSHOT, "oid",
        qualified_id(F.col("schema"), F.col("relname")).alias("relation_id"),
        "schema", F.col("relname").alias("name"),
        decode(F.col("relkind"), KINDS).alias("kind"),
        row_estimate(F.col("relkind"), F.col("reltuples")).alias("row_estimate"),
        "comment",
        F.when(F.col("relkind").isin("v", "m"), F.col("view_definition")).alias("view_definition"),
        F.when(F.col("relkind") == "p", F.col("partition_key")).alias("partition_key"),
    )


def _owners(relations: DataFrame, oid: str) -> DataFrame:
    """Captured relations as join partners: restricts child scans to what was found."""
    return relations.select(*SNAPSHOT, F.col("oid").alias(oid), "relation_id")


def enum_types(raw: Raw) -> DataFrame:
    """All enum types with their canonical ids."""
    n = raw["namespaces"].select(*SNAPSHOT, F.col("oid").alias("typnamespace"), F.col("nspname").alias("schema"))
    return (
        raw["types"].filter(F.col("typtype") == "e").join(n, SNAPSHOT + ["typnamespace"])
        .select(*SNAPSHOT, "oid", qualified_id(F.col("schema"), F.col("typname")).alias("enum_id"),
                "schema", F.col("typname").alias("name"))
    )


def scan_columns(raw: Raw, relations: DataFrame) -> DataFrame:
    """Live columns with a dense ordinal and the enum they use, directly or as array element."""
    types = raw["types"].select(
        *SNAPSHOT, F.col("oid").alias("atttypid"), "typtype",
        F.when(F.col("typcategory") == "A", F.col("typelem")).alias("element"))
    enums = enum_types(raw).select(*SNAPSHOT, F.col("oid").alias("enum_oid"), "enum_id")
    # Each type once with the enum behind it: the type's own id, else its element's.
    linked = small(
        types.withColumn("enum_oid", F.when(F.col("typtype") == "e", F.col("atttypid")).otherwise(F.col("element")))
        .join(enums, SNAPSHOT + ["enum_oid"], "left")
        .select(*SNAPSHOT, "atttypid", "enum_id"))
    generated = F.col("attgenerated") != ""
    # A relation is one oid: numbered where the join with its owner has put it.
    position = Window.partitionBy(*SNAPSHOT, "attrelid", "relation_id").orderBy("attnum")
    return (
        raw["attributes"].filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
        .join(linked, SNAPSHOT + ["atttypid"])
        .join(_owners(relations, "attrelid"), SNAPSHOT + ["attrelid"])
        .select(
            *SNAPSHOT, "relation_id", F.row_number().over(position).alias("ordinal"),
            F.col("attname").alias("name"), F.col("type_text").alias("type"),
            (~F.col("attnotnull")).alias("nullable"),
            F.when(~generated, F.col("expr")).alias("default"),
            decode(F.col("attidentity"), IDENTITIES).alias("identity"),
            F.when(generated, F.col("expr")).alias("generated"),
            "comment", "enum_id",
        )
    )


def _attribute_names(raw: Raw, relid: str) -> DataFrame:
    """One map attnum -> name per relation, so key arrays need one join and no re-grouping."""
    entries = F.collect_list(F.struct("attnum", "attname"))
    return (
        raw["attributes"].groupBy(*SNAPSHOT, F.col("attrelid").alias(relid))
        .agg(F.map_from_entries(entries).alias(f"{relid}_names"))
    )


def _names(positions: Column, names: Column) -> Column:
    """Key positions to column names, in key order; unknown positions are dropped."""
    found = F.transform(positions, lambda number: F.try_element_at(names, number))
    return F.filter(found, lambda name: name.isNotNull())


def scan_constraints(raw: Raw, relations: DataFrame) -> DataFrame:
    """Primary keys, unique and check constraints of captured relations."""
    own = raw["constraints"].filter(F.col("contype").isin("p", "u", "c") & (F.col("conparentid") == 0))
    return (
        own.join(_owners(relations, "conrelid"), SNAPSHOT + ["conrelid"])
        .join(_attribute_names(raw, "conrelid"), SNAPSHOT + ["conrelid"], "left")
        .select(*SNAPSHOT, "relation_id", F.col("conname").alias("name"), F.col("contype").alias("ctype"),
                _names(F.col("conkey"), F.col("conrelid_names")).alias("columns"),
                "definition", F.col("conindid").alias("index_oid"))
    )


def scan_foreign_keys(raw: Raw, relations: DataFrame) -> DataFrame:
    """Foreign keys of captured relations; targets may lie outside the scope."""
    targets = (
        raw["relations"].select(*SNAPSHOT, F.col("oid").alias("confrelid"), "relnamespace", F.col("relname").alias("ref_name"))
        .join(raw["namespaces"].select(*SNAPSHOT, F.col("oid").alias("relnamespace"), F.col("nspname").alias("ref_schema")),
              SNAPSHOT + ["relnamespace"])
        .join(_attribute_names(raw, "confrelid"), SNAPSHOT + ["confrelid"], "left")
        .drop("relnamespace")
    )
    own = raw["constraints"].filter((F.col("contype") == "f") & (F.col("conparentid") == 0))
    return (
        own.join(_owners(relations, "conrelid"), SNAPSHOT + ["conrelid"])
        .join(_attribute_names(raw, "conrelid"), SNAPSHOT + ["conrelid"], "left")
        .join(targets, SNAPSHOT + ["confrelid"], "left")
        .select(
            *SNAPSHOT, "relation_id", F.col("conname").alias("name"),
            _names(F.col("conkey"), F.col("conrelid_names")).alias("columns"),
            "ref_schema", "ref_name",
            qualified_id(F.col("ref_schema"), F.col("ref_name")).alias("ref"),
            _names(F.col("confkey"), F.col("confrelid_names")).alias("ref_columns"),
            decode(F.col("confdeltype"), ACTIONS, "no action").alias("on_delete"),
            decode(F.col("confupdtype"), ACTIONS, "no action").alias("on_update"),
            decode(F.col("confmatchtype"), MATCHES, "simple").alias("match"),
            F.col("condeferrable").alias("deferrable"), F.col("condeferred").alias("initially_deferred"),
            F.col("convalidated").alias("validated"), "definition",
        )
    )


def scan_indexes(raw: Raw, relations: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes with key columns or expressions, includes, and the constraint they implement."""
    implemented = constraints.filter(F.col("ctype").isin("p", "u")).select(
        *SNAPSHOT, "relation_id", F.col("index_oid").alias("indexrelid"), F.col("name").alias("constraint_name"))
    columns = F.transform("indkey", lambda number: F.try_element_at(F.col("indrelid_names"), number))
    keys = F.transform(
        F.slice("columns", F.lit(1), F.col("indnkeyatts")),
        lambda column, at: F.struct(
            column.alias("column"),
            F.when(column.isNull(), F.coalesce(F.get(F.col("key_defs"), at), F.lit(""))).alias("expression")),
    )
    return (
        raw["indexes"].join(_owners(relations, "indrelid"), SNAPSHOT + ["indrelid"])
        .join(_attribute_names(raw, "indrelid"), SNAPSHOT + ["indrelid"], "left")
        .withColumn("columns", columns)
        .join(implemented, SNAPSHOT + ["relation_id", "indexrelid"], "left")
        .select(
            *SNAPSHOT, "relation_id", F.col("relname").alias("name"), F.col("amname").alias("method"),
            keys.alias("keys"),
            F.slice("columns", F.col("indnkeyatts") + 1, F.size("columns")).alias("include"),
            F.col("indisunique").alias("is_unique"), F.col("indisprimary").alias("is_primary"),
            F.col("indisvalid").alias("valid"), "predicate", "constraint_name", "definition",
        )
    )


def scan_enums(raw: Raw, columns: DataFrame) -> DataFrame:
    """Enums of the configured schemas, used or not, plus outside enums that a captured column uses."""
    scopes = raw["scopes"].select(*SNAPSHOT, "schema")
    types = enum_types(raw)
    used = columns.filter(F.col("enum_id").isNotNull()).select(*SNAPSHOT, "enum_id").distinct()
    inside = types.join(scopes, SNAPSHOT + ["schema"], "left_semi").withColumn("external", F.lit(False))
    outside = (
        types.join(scopes, SNAPSHOT + ["schema"], "left_anti")
        .join(used, SNAPSHOT + ["enum_id"], "left_semi").withColumn("external", F.lit(True))
    )
    labels = raw["enum_labels"].groupBy(*SNAPSHOT, F.col("enumtypid").alias("oid")).agg(
        ordered_list(F.col("enumsortorder"), F.col("enumlabel")).alias("values"))
    return (
        inside.unionByName(outside).join(labels, SNAPSHOT + ["oid"], "left")
        .select(*SNAPSHOT, "enum_id", "schema", "name",
                F.coalesce("values", F.array().cast("array<string>")).alias("values"), "external")
    )
