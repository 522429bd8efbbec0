"""Name resolution and batched detail with one-hop neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.idents import parse_name, qualified_id, trim_all
from ..functions.text import clip, is_cut, pointer, prose, unix_lines
from ..keys import FIELD_LIMIT, LONG_LIMIT, REQUEST_MAX, SNAPSHOT
from ..operators import lines, rules
from ..operators.diff import page_warnings
from ..operators.pages import column_notes, overrides
from ..operators.references import edges, external_targets, neighbors
from ..session import cut
from ..sources.store import Tables, each

REQUEST = ["catalog_id", "request_id"]


def resolve_names(requests: DataFrame, known: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve ``(catalog_id, request_id, pos, input)`` against ``known(catalog_id, relation_id, name)``.

    Two-part names match exactly, one-part names are tried in every configured
    schema. Returns one row per input with ``code`` (ok, invalid_name,
    ambiguous_name, unknown_relation), and the candidates of failed inputs as rows.
    """
    parsed = requests.withColumn("parts", parse_name(F.col("input")))
    key = REQUEST + ["pos"]
    two = parsed.filter(F.size("parts") == 2).select(*key, qualified_id(F.get("parts", 0), F.get("parts", 1)).alias("relation_id"), F.lit(0).alias("position"))
    one = parsed.filter(F.size("parts") == 1).join(scopes.select("catalog_id", "schema", "position"), "catalog_id").select(
        *key, qualified_id(F.col("schema"), F.get("parts", 0)).alias("relation_id"), "position")
    hits = two.unionByName(one).join(known.select("catalog_id", "relation_id"), ["catalog_id", "relation_id"], "left_semi")
    counted = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("relation_id").alias("relation_id"))
    # Problems, accepted requests and the selection all read the result: evaluate it once.
    resolved = cut(parsed.join(counted, key, "left").select(
        *key, "input",
        F.when(F.col("parts").isNull(), "invalid_name").when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous_name")
        .otherwise("unknown_relation").alias("code"),
        F.when(F.col("n") == 1, F.col("relation_id")).alias("relation_id"),
        F.lower(F.element_at("parts", -1)).alias("low_name")))
    ambiguous = resolved.filter(F.col("code") == "ambiguous_name").select(*key).join(hits, key).select(*key, F.col("relation_id").alias("candidate"))
    similar = (
        resolved.filter(F.col("code") == "unknown_relation").select(*key, "low_name")
        .join(known.select("catalog_id", F.lower("name").alias("low_name"), F.col("relation_id").alias("candidate")), ["catalog_id", "low_name"])
        .select(*key, "candidate")
    )
    return resolved.drop("low_name"), ambiguous.unionByName(similar)


def bounded_candidates(candidates: DataFrame, limit: int = REQUEST_MAX) -> DataFrame:
    """The first ``limit`` candidates of each failed input by name, with their ``place`` and the number that was left out.

    A name that thousands of relations share does not make an answer of
    thousands; the limit is applied before the shuffle.
    """
    key = REQUEST + ["pos"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("candidate"))
    counted = candidates.groupBy(*key).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted"))
    return candidates.withColumn("place", place).filter(F.col("place") <= limit).join(counted, key)


def first_problems(resolved: DataFrame, limit: int = REQUEST_MAX) -> DataFrame:
    """Why a request is refused: its first bad name by position, or ``too_many_relations`` (without position and input).

    Every request is either here or in :func:`accepted`.
    """
    bad = resolved.filter(F.col("code") != "ok").groupBy(*REQUEST).agg(
        F.min_by(F.struct("pos", "input", "code"), "pos").alias("p")).select(*REQUEST, "p.pos", "p.input", "p.code")
    large = requested(resolved).groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    refused = large.join(bad.select(*REQUEST), REQUEST, "left_anti").select(
        *REQUEST, F.lit(None).cast(resolved.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("input"),
        F.lit("too_many_relations").alias("code"))
    return bad.unionByName(refused)


def requested(resolved: DataFrame) -> DataFrame:
    """Resolved ids of each request, first occurrence kept."""
    return resolved.filter(F.col("code") == "ok").groupBy(*REQUEST, "relation_id").agg(F.min("pos").alias("pos"))


def accepted(resolved: DataFrame, limit: int = REQUEST_MAX) -> DataFrame:
    """Requests without a problem, as rows of their relations."""
    return requested(resolved).join(first_problems(resolved, limit).select(*REQUEST), REQUEST, "left_anti")


def selection(tables: Tables, seeds: DataFrame, related: bool, graph: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Requested relations in request order, then their neighbours by id.

    ``graph`` holds the edges of the relations, where a caller has them stored.
    ``omitted`` counts the neighbours that a ``cap`` left out; it stands on the
    neighbours' rows.
    """
    # A snapshot's scope says that it exists; its revision would need all hashes.
    snapshot_ids = tables["scopes"].select(*SNAPSHOT).distinct()
    keyed = seeds.join(snapshot_ids, "catalog_id")
    own = keyed.select(
        *SNAPSHOT, "request_id", "relation_id", F.lit(False).alias("is_neighbor"), F.col("pos").cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("omitted"))
    if not related:
        return own
    found = neighbors(edges(tables["foreign_keys"], tables["relations"]) if graph is None else graph, keyed, cap)
    return own.unionByName(found.select(
        *SNAPSHOT, "request_id", F.col("neighbor").alias("relation_id"), F.lit(True).alias("is_neighbor"), F.col("position").alias("pos"), "omitted"))


def restrict(tables: Tables, chosen: DataFrame) -> Tables:
    """Snapshot tables limited to the chosen relations, before anything is rendered."""
    keys = chosen.select(*SNAPSHOT, "relation_id").distinct()
    return each(tables, lambda frame: frame.join(keys, SNAPSHOT + ["relation_id"], "left_semi") if "relation_id" in frame.columns else frame)


def detail(tables: Tables, parsed_pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Structure lines of every chosen relation, once however many requests chose it.

    A hub near many requests has its lines here one time; ``chosen`` says who
    asked, and joining the two for one request shows that request's answer.
    """
    return lines.all_lines(restrict(tables, chosen), overrides(column_notes(parsed_pages)))


def detail_warnings(tables: Tables, parsed_pages: DataFrame, subject: DataFrame, chosen: DataFrame) -> DataFrame:
    """Warnings ``(source, check_no, code)`` of every chosen relation, once however many requests chose it.

    A relation is not called undocumented while its page cannot be read.
    """
    key = ["catalog_id", "relation_id"]
    wanted = chosen.select(*key).distinct()
    broken = parsed_pages.filter(~F.col("ok")).select(*key, F.lit("undocumented").alias("code"))
    rule = rules.warnings(tables, parsed_pages.filter("ok"), column_notes(parsed_pages)).join(broken, key + ["code"], "left_anti")
    page = page_warnings(subject)
    either = rule.select(*key, F.lit("rule").alias("source"), "check_no", "code").unionByName(page.select(*key, F.lit("page").alias("source"), "check_no", "code"))
    return either.join(wanted, key, "left_semi")


def detail_external(tables: Tables, chosen: DataFrame) -> DataFrame:
    """Targets outside the capture that the chosen relations of a request name."""
    limited = tables["foreign_keys"].join(chosen.select(*SNAPSHOT, "relation_id").distinct(), SNAPSHOT + ["relation_id"], "left_semi")
    found = external_targets(limited, tables["relations"])
    return chosen.join(found, SNAPSHOT + ["relation_id"]).select(*SNAPSHOT, "request_id", "ref").distinct()


def detail_enums(tables: Tables, chosen: DataFrame) -> DataFrame:
    """Enums that any column of a request's relations uses, once per request."""
    used = tables["columns"].filter(F.col("enum_id").isNotNull()).select(*SNAPSHOT, "relation_id", "enum_id").distinct()
    wanted = chosen.join(used, SNAPSHOT + ["relation_id"]).select(*SNAPSHOT, "request_id", "enum_id").distinct()
    return wanted.join(tables["enums"].select(*SNAPSHOT, "enum_id", "values", "external"), SNAPSHOT + ["enum_id"])


def human_context(tables: Tables, parsed_pages: DataFrame) -> DataFrame:
    """Untrusted text of relations as rows ``(field, item, value, truncated, pointer)``.

    Cleaned, trimmed and clipped; blank values are left out. ``item`` is the
    tag number or column name, cleaned as well. The pointer is set where text was cut.
    """
    key = ["catalog_id", "relation_id"]
    valid = parsed_pages.filter("ok")

    def rows(frame: DataFrame, field: str, item, text, limit: int) -> DataFrame:
        return frame.select(
            *key, F.lit(field).alias("field"), (F.lit("") if item is None else item.cast("string")).alias("item"),
            text.alias("text"), F.lit(limit).alias("limit"))

    body = F.concat_ws("\n\n", F.nullif(trim_all(unix_lines(F.col("before"))), F.lit("")), F.nullif(trim_all(unix_lines(F.col("after"))), F.lit("")))
    tags = valid.select(*key, F.posexplode("tags").alias("at", "tag"))
    notes = column_notes(parsed_pages)
    parts = [
        rows(valid, "purpose", None, F.col("purpose"), FIELD_LIMIT),
        rows(valid, "owner", None, F.col("owner"), FIELD_LIMIT),
        rows(tags, "tags", F.col("at"), F.col("tag"), FIELD_LIMIT),
        rows(tables["relations"], "comment", None, F.col("comment"), FIELD_LIMIT),
        rows(tables["columns"], "colComments", F.col("name"), F.col("comment"), FIELD_LIMIT),
        rows(notes, "colNotes", clip(F.coalesce(prose(F.col("name")), F.lit("")), FIELD_LIMIT), F.col("note"), FIELD_LIMIT),
        rows(valid, "notes", None, body, LONG_LIMIT),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # One cleaning projection over all fields, then clipping on its result.
    cleaned = every.filter(F.col("text").isNotNull()).withColumn("full", prose(F.col("text"))).filter(F.col("full").isNotNull())
    path = F.when(F.col("item") == "", pointer("untrusted", F.col("field"))).otherwise(pointer("untrusted", F.col("field"), F.col("item")))
    cut_off = is_cut(F.col("full"), F.col("limit"))
    return cleaned.select(
        *key, "field", "item", clip(F.col("full"), F.col("limit")).alias("value"), cut_off.alias("truncated"), F.when(cut_off, path).alias("pointer"))


def detail_context(tables: Tables, parsed_pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Human context of every chosen relation, once; only relations that a request names have note bodies."""
    key = ["catalog_id", "relation_id"]
    wanted = chosen.groupBy(*key).agg(F.bool_and("is_neighbor").alias("__near"))
    limited = {name: tables[name].join(wanted, key, "left_semi") for name in ("relations", "columns")}
    found = human_context(limited, parsed_pages.join(wanted, key, "left_semi"))
    return found.join(wanted, key).filter(~(F.col("__near") & (F.col("field") == "notes"))).drop("__near")


def detail_entries(chosen: DataFrame, subject: DataFrame) -> DataFrame:
    """One head row per chosen relation: lifecycle state, context file, and whether notes are unreadable.

    Relations known only by their page appear with their archived state and no structure lines.
    """
    facts = subject.select("catalog_id", "relation_id", F.col("due_state").alias("state"), F.col("path").alias("context_file"),
                           (F.col("has_page") & ~F.coalesce("ok", F.lit(False))).alias("partial"))
    return chosen.join(facts, ["catalog_id", "relation_id"], "left").withColumn("partial", F.col("partial") & ~F.col("is_neighbor"))
