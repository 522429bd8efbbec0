"""Structural, documentation and revision hashes.

Two relations hash equal exactly when the listed content is equal. Every
section is hashed on its own, so "which sections changed" is a comparison of
ten columns. Child rows are hashed row by row and summed (see
``functions.hashing``): no ordered collection, map-side combine everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest, empty_digest, encode, encode_list, lane_digest, lane_sums
from ..keys import COVERAGE, FORMAT, RELATION, SECTIONS, SNAPSHOT

Snapshot = dict[str, DataFrame]


def enum_hash() -> Column:
    """Schema, name and ordered values; not the external flag."""
    return digest(encode(F.col("schema")), encode(F.col("name")), encode_list(F.col("values")))


def _index_keys() -> Column:
    parts = F.transform("keys", lambda k: F.concat(encode(k["column"]), encode(k["expression"])))
    return F.concat(F.lit("["), F.size("keys").cast("string"), F.lit("]"), F.array_join(parts, ""))


#: Sections and the child table whose rows they are made of; ``documentation`` is not structural.
_MADE_OF = {
    "columns": ["columns", "documentation"], "constraints": ["primaryKey", "uniques", "checks"], "foreign_keys": ["foreignKeys"], "indexes": ["indexes"]}


def _row_hash(section: str) -> Column:
    """Hash of a child row as part of ``section``."""
    of = lambda *names: [encode(F.col(name)) for name in names]
    if section == "columns":
        return digest(*of("ordinal", "name", "type", "nullable", "default", "identity", "generated"))
    if section == "documentation":
        return digest(*of("ordinal", "name", "comment"))
    if section == "foreignKeys":
        return digest(
            *of("name"), encode_list(F.col("columns")), *of("ref_schema", "ref_name"), encode_list(F.col("ref_columns")),
            *of("on_delete", "on_update", "match", "deferrable", "initially_deferred", "validated", "definition"))
    if section == "indexes":
        return digest(*of("name", "method"), _index_keys(), encode_list(F.col("include")), *of("is_unique", "is_primary", "valid", "predicate", "definition"))
    return digest(*of("name"), encode_list(F.col("columns")), *of("definition"))


def _key_section() -> Column:
    return F.when(F.col("ctype") == "p", "primaryKey").when(F.col("ctype") == "u", "uniques").otherwise("checks")


def child_rows(snapshot: Snapshot) -> DataFrame:
    """One row hash per column, constraint, foreign key and index, labelled with its section; ``documentation`` is not structural."""
    rows = None
    for table, sections in _MADE_OF.items():
        # A constraint belongs to one of its sections, any other row to all of them.
        labels = [(_key_section(), sections[0])] if table == "constraints" else [(F.lit(s), s) for s in sections]
        for label, section in labels:
            part = snapshot[table].select(*RELATION, label.alias("section"), _row_hash(section).alias("row_hash"))
            rows = part if rows is None else rows.unionByName(part)
    return rows


def _section_hashes(rows: DataFrame, sections: list[str]) -> DataFrame:
    """``RELATION, h_…``: one grouping of ``rows``, which hold ``section`` and ``row_hash``, or ``row_…`` of every section."""
    every = []
    for section in sections:
        sums = lane_sums(F.col(f"row_{section}")) if f"row_{section}" in rows.columns else lane_sums(F.col("row_hash"), F.col("section") == section)
        every.append(F.struct(*sums).alias(section))
    return rows.groupBy(*RELATION).agg(*every).select(*RELATION, *[lane_digest(section).alias(f"h_{section}") for section in sections])


def child_hashes(snapshot: Snapshot) -> list[DataFrame]:
    """The section hashes of each child table and of used enums, all keyed and dealt by ``RELATION``."""
    found = []
    for table, sections in _MADE_OF.items():
        hashed = (
            [_key_section().alias("section"), _row_hash(sections[0]).alias("row_hash")] if table == "constraints"
            else [_row_hash(section).alias(f"row_{section}") for section in sections])
        found.append(_section_hashes(snapshot[table].select(*RELATION, *hashed), sections))
    return [*found, _section_hashes(enum_rows(used_enums(snapshot)), ["enums"])]


def used_enums(snapshot: Snapshot) -> DataFrame:
    """``RELATION, enum_id, schema, name, values``: the enums of each relation's columns, once each; unknown ones without content."""
    used = snapshot["columns"].filter(F.col("enum_id").isNotNull()).select(*RELATION, "enum_id").distinct()
    known = snapshot["enums"].select(*SNAPSHOT, "enum_id", "schema", "name", "values")
    return used.join(known, SNAPSHOT + ["enum_id"], "left").select(*RELATION, "enum_id", "schema", "name", "values")


def enum_rows(used: DataFrame) -> DataFrame:
    """One row hash per enum that a relation uses."""
    content = F.concat(encode(F.col("schema")), encode(F.col("name")), encode_list(F.col("values")))
    unknown = F.concat(encode(F.col("enum_id")), F.lit("~"))
    return used.select(*RELATION, F.lit("enums").alias("section"), F.sha2(F.when(F.col("name").isNotNull(), content).otherwise(unknown), 256).alias("row_hash"))


def section_rows(snapshot: Snapshot) -> DataFrame:
    """One row hash per child row and used enum, labelled with its section."""
    return child_rows(snapshot).unionByName(enum_rows(used_enums(snapshot)))


def relation_hashes(snapshot: Snapshot) -> DataFrame:
    """Per relation: a hash per section, the structural ``hash`` and ``doc_hash``."""
    scalar = {"kind": "kind", "view": "view_definition", "partitionKey": "partition_key"}
    joined = snapshot["relations"].select(*RELATION, "schema", "comment", *scalar.values())
    # Children are summed by relation table by table: all sides are dealt alike, so the joins shuffle nothing again.
    for part in child_hashes(snapshot):
        joined = joined.join(part, RELATION, "left")
    hashed = joined.select(
        *RELATION, "schema", "comment",
        *[
            (digest(encode(F.col(scalar[s]))) if s in scalar else F.coalesce(F.col(f"h_{s}"), empty_digest())).alias(f"s_{s}")
            for s in SECTIONS
        ],
        F.coalesce("h_documentation", empty_digest()).alias("h_documentation"),
    )
    structural = F.sha2(F.concat(*[F.col(f"s_{s}") for s in SECTIONS]), 256)
    return (
        hashed.withColumn("hash", structural)
        .withColumn("doc_hash", digest(F.col("hash"), encode(F.col("comment")), F.col("h_documentation")))
        .select(*RELATION, "schema", *[f"s_{s}" for s in SECTIONS], "hash", "doc_hash")
    )


def scope_lists(scopes: DataFrame) -> DataFrame:
    """The ordered schema list of each snapshot."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "schema")))
    return scopes.groupBy(*SNAPSHOT).agg(F.transform(pairs, lambda p: p["schema"]).alias("schemas"))


def revisions(hashes: DataFrame, enums: DataFrame, scopes: DataFrame) -> DataFrame:
    """One hash per snapshot over scope, relations and enums, however many there are."""
    relations = (
        hashes.groupBy(*SNAPSHOT)
        .agg(*lane_sums(digest(encode(F.col("relation_id")), F.col("hash"), F.col("doc_hash"))))
        .select(*SNAPSHOT, F.col("n").alias("relations"), lane_digest().alias("relations_hash"))
    )
    listed = (
        enums.groupBy(*SNAPSHOT)
        .agg(*lane_sums(digest(encode(F.col("enum_id")), enum_hash(), encode(F.col("external")))))
        .select(*SNAPSHOT, F.col("n").alias("enums"), lane_digest().alias("enums_hash"))
    )
    return (
        scope_lists(scopes).join(relations, SNAPSHOT, "left").join(listed, SNAPSHOT, "left")
        .select(
            *SNAPSHOT, "schemas", F.coalesce("relations", F.lit(0)).alias("relations"),
            F.coalesce("enums", F.lit(0)).alias("enums"),
            digest(encode(F.lit(FORMAT)), encode(F.lit(COVERAGE)), encode_list(F.col("schemas")),
                   F.coalesce("relations_hash", empty_digest()), F.coalesce("enums_hash", empty_digest())).alias("revision"))
    )
