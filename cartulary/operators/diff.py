"""Keyed comparison of snapshots and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..keys import SECTIONS
from ..session import small

Tables = dict[str, DataFrame]
RELATION = ["catalog_id", "relation_id"]


def _in_scope(frame: DataFrame, scopes: DataFrame) -> DataFrame:
    return frame.join(scopes.select("catalog_id", "schema"), ["catalog_id", "schema"], "left_semi")


def marked(hashes: DataFrame) -> DataFrame:
    """``hashes`` with 128 bits, ``m_…`` and ``w_…``, for the 64 hex digits of each section: what a comparison shuffles."""
    marks = {f"m_{s}": F.xxhash64(f"s_{s}") for s in SECTIONS} | {f"w_{s}": F.xxhash64(F.lit(s), f"s_{s}") for s in SECTIONS}
    return hashes.select("*", *[mark.alias(name) for name, mark in marks.items()]).drop(*[f"s_{s}" for s in SECTIONS])


def changed_sections(left: str, right: str) -> F.Column:
    """Names of the sections whose marks differ, in fixed order."""
    same = lambda s: (F.col(f"{left}.m_{s}") == F.col(f"{right}.m_{s}")) & (F.col(f"{left}.w_{s}") == F.col(f"{right}.w_{s}"))
    return F.array_compact(F.array(*[F.when(~same(s), s) for s in SECTIONS]))


def relation_diff(stored: Tables, live: Tables, scopes: DataFrame) -> DataFrame:
    """Added, removed and changed relations; changed ones with their sections.

    The stored side is limited to the configured scope: a narrower scope is not a removal.
    """
    old = marked(_in_scope(stored["hashes"], scopes)).alias("old")
    new = marked(live["hashes"]).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in RELATION]
    both = F.col("old.hash").isNotNull() & F.col("new.hash").isNotNull()
    return (
        old.join(new, on, "full")
        .filter(~F.col("old.hash").eqNullSafe(F.col("new.hash")))
        .select(
            *[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in RELATION],
            F.when(F.col("old.hash").isNull(), "relation_added").when(F.col("new.hash").isNull(), "relation_removed")
            .otherwise("relation_changed").alias("code"),
            F.when(both, changed_sections("old", "new")).alias("sections"))
    )


def documentation_diff(stored: Tables, live: Tables, scopes: DataFrame) -> DataFrame:
    """Relations on both sides whose table comment or column comments changed.

    Comments are compared only where the documentation hashes differ.
    """
    suspects = (
        _in_scope(stored["hashes"], scopes).select(*RELATION, F.col("doc_hash").alias("old"))
        .join(live["hashes"].select(*RELATION, F.col("doc_hash").alias("new")), RELATION)
        .filter(F.col("old") != F.col("new")).select(*RELATION)
    )
    differ = ~F.col("old").eqNullSafe(F.col("new"))

    def sides(name: str, key: list[str], extra: list[str]) -> DataFrame:
        old = stored[name].join(suspects, RELATION, "left_semi").select(*key, F.col("comment").alias("old"))
        new = live[name].join(suspects, RELATION, "left_semi").select(*key, *extra, F.col("comment").alias("new"))
        return old.join(new, key).filter(differ)

    table = sides("relations", RELATION, []).select(*RELATION, F.lit(True).alias("table_changed"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    columns = sides("columns", RELATION + ["name"], ["ordinal"]).groupBy(*RELATION).agg(
        F.transform(ordered, lambda c: c["name"]).alias("columns"))
    return table.join(columns, RELATION, "full").select(
        *RELATION, F.lit("relation_documentation_changed").alias("code"),
        F.coalesce("table_changed", F.lit(False)).alias("table_changed"), "columns")


def enum_diff(stored: Tables, live: Tables, scopes: DataFrame, enum_hash: F.Column) -> DataFrame:
    """Added, changed and removed enums; a removed one counts if external or in scope."""
    configured = scopes.select("catalog_id", "schema", F.lit(True).alias("in_scope"))
    old = (
        stored["enums"].withColumn("old", enum_hash).join(configured, ["catalog_id", "schema"], "left")
        .select("catalog_id", "enum_id", "old", (F.col("external") | F.coalesce("in_scope", F.lit(False))).alias("counts"))
    )
    new = live["enums"].select("catalog_id", "enum_id", enum_hash.alias("new"))
    return (
        old.join(new, ["catalog_id", "enum_id"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
        .filter(F.col("new").isNotNull() | F.col("counts"))
        .select("catalog_id", "enum_id",
                F.when(F.col("old").isNull(), "enum_added").when(F.col("new").isNull(), "enum_removed")
                .otherwise("enum_changed").alias("code"))
    )


def refresh_diff(previous: Tables, current: Tables) -> DataFrame:
    """Relation ids added, changed and removed between two captures, whatever the scope.

    A catalog's first capture adds nothing: there is nothing to compare with.
    """
    known = previous["snapshots"].select("catalog_id")
    old = previous["hashes"].select(*RELATION, F.col("hash").alias("old"))
    new = current["hashes"].select(*RELATION, F.col("hash").alias("new")).join(known, "catalog_id", "left_semi")
    return old.join(new, RELATION, "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select(
        *RELATION, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def hash_history(hashes: DataFrame) -> DataFrame:
    """Change of every relation from one snapshot to the next over a whole history."""
    order = Window.partitionBy(*RELATION).orderBy("snapshot_id")
    before = F.lag("hash").over(order)
    return hashes.select(
        *RELATION, "snapshot_id",
        F.when(before.isNull(), "first").when(before != F.col("hash"), "changed").otherwise("same").alias("change"))


def history_intervals(hashes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A history of any number of snapshots as intervals ``RELATION, hash, valid_from, valid_to, snapshots``.

    An interval is a run of snapshots of a catalog in which the relation has
    one hash; ``valid_to`` is the first snapshot without it, null if it still
    holds. A relation that is missing for a while has an interval on both
    sides. Windows go over the snapshots of one catalog or relation only.
    """
    order = Window.partitionBy("catalog_id").orderBy("snapshot_id")
    dated = snapshots.select("catalog_id", "snapshot_id").distinct().select(
        "catalog_id", "snapshot_id", F.row_number().over(order).alias("at"), F.lead("snapshot_id").over(order).alias("next"))
    same = Window.partitionBy(*RELATION, "hash").orderBy("at")
    # Snapshots are few beside relations, which so are shuffled once; within a run of neighbours, place and rank grow together.
    runs = hashes.select(*RELATION, "snapshot_id", "hash").join(small(dated), ["catalog_id", "snapshot_id"]).withColumn("run", F.col("at") - F.row_number().over(same))
    return runs.groupBy(*RELATION, "hash", "run").agg(
        F.min("snapshot_id").alias("valid_from"), F.max_by("next", "at").alias("valid_to"), F.count(F.lit(1)).alias("snapshots")).drop("run")


def scope_mismatch(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Catalogs whose configured schema list differs from the stored one, order included."""
    old = stored.select("catalog_id", F.col("schemas").alias("stored"))
    new = configured.select("catalog_id", F.col("schemas").alias("configured"))
    return old.join(new, "catalog_id", "full").filter(~F.col("stored").eqNullSafe(F.col("configured")))


def page_checks(subject: DataFrame) -> DataFrame:
    """Live relations against page hashes, first mismatch only; and pages without a relation."""
    live = (
        F.when(~F.col("has_page"), "page_missing").when(~F.col("ok"), "page_invalid")
        .when(F.col("state") != "active", "page_archived_but_present")
        .when(F.col("hash") != F.col("live_hash"), "page_structure_mismatch")
        .when(F.col("doc_hash") != F.col("live_doc_hash"), "page_documentation_mismatch")
    )
    alone = F.when(~F.col("ok"), "page_invalid").when(F.col("state") == "active", "page_not_archived").otherwise("page_archived")
    return (
        subject.withColumn("code", F.when(F.col("captured"), live).otherwise(alone)).filter(F.col("code").isNotNull())
        .select(*RELATION, "captured", "code", F.col("path").alias("file"),
                F.when(F.col("code").isin("page_archived_but_present", "page_archived"), F.col("state")).alias("page_state"),
                F.when(F.col("code") == "page_invalid", F.col("reason")).alias("reason"))
    )


def page_warnings(subject: DataFrame) -> DataFrame:
    """Local page checks of retrieval, in the same first-match order."""
    live = (
        F.when(~F.col("has_page"), "page_missing").when(~F.col("ok"), "context_invalid")
        .when((F.col("state") != "active") | (F.col("hash") != F.col("live_hash")), "page_structure_mismatch")
        .when(F.col("doc_hash") != F.col("live_doc_hash"), "page_documentation_mismatch")
    )
    archived = F.array(
        F.when(F.col("due_state") == "removed", "page_removed").otherwise("page_out_of_scope"),
        F.when(~F.col("ok"), "context_invalid"))
    codes = F.when(F.col("captured"), F.array(live)).otherwise(archived)
    return (
        subject.select(*RELATION, "captured", "state", "reason", F.posexplode(F.filter(codes, lambda c: c.isNotNull())).alias("check_no", "code"))
        .select(*RELATION, F.col("check_no"), "code",
                F.when((F.col("code") == "page_structure_mismatch") & (F.col("state") != "active"), F.col("state")).alias("page_state"),
                F.when(F.col("code") == "context_invalid", F.col("reason")).alias("reason"))
    )
