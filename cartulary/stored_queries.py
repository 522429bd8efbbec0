"""Registered queries on what is stored: saved snapshots, kept hashes, published pages, histories, the name index.

They write what they then read, below the shared folder, from whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .keys import RELATION, SNAPSHOT
from .operators import diff, grams, pages, scrub
from .operators.hashes import relation_hashes
from .plans import detail as details
from .plans import drift as drifts
from .plans import incremental, page_text
from .queries import LIVE, SEARCH_TEXTS, STORED, _landed, notes, overrides, query, raw, resolution, snapshot, subjects, summary
from .session import shared_folder
from .sources import books, manifest, published, saved
from .sources.raw import SCHEMAS, checked_scopes
from .sources.store import land


def fresh(spark, name: str) -> str:
    """A folder of this run's own."""
    return f"{shared_folder(spark)}/cartulary/{name}-{uuid.uuid4().hex}"


# --- saved snapshots ---------------------------------------------------------


@query
def saved_documents(spark, folder):
    """Every document of a saved snapshot: its part, what it holds, and the names in their order."""
    docs = saved.documents(snapshot(spark, folder))
    names = F.concat(*[F.transform(name, lambda e: e["name"]) for name in saved.CHILDREN])
    return docs.select(
        *RELATION, "part", "parts", F.col("head").isNotNull().alias("has_head"), *[F.size(name).cast("long").alias(f"n_{name}") for name in saved.CHILDREN],
        F.sha2(F.array_join(names, "|"), 256).alias("names"))


@query
def saved_roundtrip(spark, folder):
    """Save all snapshots, read them back and hash what came: nothing is lost."""
    tables = snapshot(spark, folder)
    place = fresh(spark, "saved")
    saved.export(tables, place, compression="gzip")
    back, findings = saved.load(spark, place, {name: frame.schema for name, frame in tables.items()}, f"{place}/read")
    return relation_hashes(back).join(findings.select(*RELATION), RELATION, "left_anti")


def damaged(docs: DataFrame) -> DataFrame:
    """Lines of documents, some of them broken in one way each, by a rule on the relation's name."""
    rule = F.substring(F.md5("relation_id"), 1, 2)
    first = F.col("part") == 0
    at = lambda code: (rule == code) & first
    broken = docs.filter(~((rule == "05") & (F.col("parts") > 1) & (F.col("part") == F.col("parts") - 1))).withColumns({
        "head": F.when(at("01"), F.lit(None)).when(at("02"), F.col("head").withField("kind", F.lit("index"))).otherwise(F.col("head")),
        "columns": F.when(at("04"), F.transform("columns", lambda c: c.withField("type", F.concat(c["type"], F.lit("x"))))).otherwise(F.col("columns")),
        "constraints": F.when(at("07"), F.transform("constraints", lambda c: c.withField("name", F.lit(None).cast("string")))).otherwise(F.col("constraints"))})
    lines = saved.as_lines(broken.withColumn("part", F.when(at("06"), -1).otherwise(F.col("part"))))
    whole = lines.withColumn("value", F.when(at("00"), F.left("value", (F.length("value") / 2).cast("int"))).otherwise(F.col("value")))
    return whole.unionByName(whole.filter(at("03")))


@query
def saved_findings(spark, folder):
    """What the reader says about a saved snapshot with broken lines; it never stops."""
    tables = snapshot(spark, folder)
    place = fresh(spark, "damaged")
    saved.export(tables, place, compression="gzip")
    saved.save(damaged(saved.documents(tables)), f"{place}/relations", "gzip")
    _, findings = saved.load(spark, place, {name: frame.schema for name, frame in tables.items()}, f"{place}/read")
    told = F.col("flaw").isin("content_changed", "part_missing", "part_repeated", "parts_disagree")
    return findings.select(*RELATION, "part", "flaw", F.when(told, F.col("detail")).alias("detail"))


# --- hashes kept up to date --------------------------------------------------


def changes(spark, folder) -> dict[str, DataFrame]:
    def make(target):
        found = incremental.changed_tables(snapshot(spark, folder, STORED), snapshot(spark, folder, LIVE))
        return {name: land(frame, f"{target}/{name}") for name, frame in found.items()}

    return _landed(spark, folder, "changes", make)


@query
def section_changes(spark, folder):
    return incremental.change_counts(changes(spark, folder))


@query
def incremental_hashes(spark, folder):
    """The live hashes from the sums kept with the stored snapshot and the rows that changed."""
    kept = _landed(spark, folder, "lanes", lambda target: {"lanes": land(incremental.section_lanes(snapshot(spark, folder, STORED)), target)})["lanes"]
    lanes = incremental.refresh_lanes(kept, changes(spark, folder), LIVE)
    return incremental.hashes_from_lanes(lanes, snapshot(spark, folder, LIVE)["relations"])


@query
def history_intervals(spark, folder):
    """Four snapshots, two of them derived: hashes that change and come back, relations that leave and return."""
    hashes = snapshot(spark, folder)["hashes"].select(*RELATION, "hash")
    live = hashes.filter(F.col("snapshot_id") == LIVE)
    rule = F.substring(F.md5("relation_id"), 1, 1)
    third = live.filter(rule != "2").withColumns({"snapshot_id": F.lit("s3"), "hash": F.when(rule.isin("0", "1"), F.sha2("hash", 256)).otherwise(F.col("hash"))})
    fourth = live.filter(rule != "3").withColumns({"snapshot_id": F.lit("s4"), "hash": F.when(rule == "1", F.sha2("hash", 256)).otherwise(F.col("hash"))})
    every = hashes.unionByName(third).unionByName(fourth)
    return diff.history_intervals(every, every)


# --- published content -------------------------------------------------------


@query
def published_pages(spark, folder):
    """Pages published, refreshed and published again, and a third time: which of them were written."""
    place = fresh(spark, "published")
    stored = notes(spark, folder)["note_pages"].select("path", "text")
    after = pages.lifecycle(subjects(spark, folder)).filter("has_page").select("path", F.col("new_text").alias("text"))
    runs = [published.publish(rows, ["path"], "text", place).select("path", F.col("written").alias(name)) for name, rows in (("first", stored), ("second", after), ("third", after))]
    out = published.published(spark, [("path", "string")], "text", place).select("path", F.sha2("text", 256).alias("stored"))
    for run in runs:
        out = out.join(run, "path", "full")
    return out


@query
def run_log_once(spark, folder):
    """A run that logs twice under its id leaves one line; another run has its own."""
    place = fresh(spark, "log")
    for run, moment in (("r1", "2026-09-25 10:30:00"), ("r1", "2026-09-25 10:30:00"), ("r2", "2026-09-25 11:30:00")):
        published.append_once(drifts.run_log(summary(spark, folder), F.to_timestamp(F.lit(moment))), place, run)
    return spark.read.schema("catalog_id string, line string, run_id string").parquet(place)


@query
def page_books(spark, folder):
    """All note pages through books and back."""
    place = fresh(spark, "books")
    books.write_books(notes(spark, folder)["note_pages"], place)
    return books.read_books(spark, place).select("catalog_id", "relation_id", "schema", "path", F.sha2("text", 256).alias("hash"), F.length("text").alias("n_chars"))


def texts(spark, folder) -> DataFrame:
    def make(target):
        return {"texts": land(page_text.page_texts(snapshot(spark, folder, LIVE), overrides(spark, folder)), target)}

    return _landed(spark, folder, "texts", make)["texts"]


@query
def page_texts(spark, folder):
    return texts(spark, folder).withColumn("text", F.sha2("text", 256))


@query
def page_refresh(spark, folder):
    """Every page after a refresh that also renders what its hashes stand for."""
    found = page_text.refreshed(subjects(spark, folder), texts(spark, folder))
    return found.select("catalog_id", "relation_id", "action", F.sha2("new_text", 256).alias("new_hash"), F.length("new_text").alias("n_chars"))


# --- extracts, names ---------------------------------------------------------


@query
def torn_extracts(spark, folder):
    """Manifests of the extracts, some of which tell of several moments, other counts or fewer tables."""
    tables = {name: raw(spark, folder)[name] for name in SCHEMAS}
    end = F.right("catalog_id", F.lit(1))
    told = manifest.counts(tables).withColumns({
        "mark": F.concat_ws("/", *SNAPSHOT, F.when((end == "5") & (F.col("part") == "indexes"), "later")),
        "rows": F.col("rows") + F.when((end == "3") & (F.col("snapshot_id") == "s1") & (F.col("part") == "attributes"), 1).otherwise(0)})
    return manifest.extract_findings(tables, told.filter(~((end == "8") & (F.col("part") == "types"))))


@query
def scope_settings(spark, folder):
    """Configured schemas of every catalog: lists with repeats, empty names, none at all."""
    scopes = raw(spark, folder)["scopes"]
    end = F.right("catalog_id", F.lit(1))
    more = scopes.filter((F.col("schema") == "sales") & end.isin("5", "7")).withColumns({"position": F.lit(99), "schema": F.when(end == "5", F.col("schema")).otherwise("")})
    return checked_scopes(scopes.filter(end != "6").unionByName(more), scopes).withColumn("schemas", F.array_join("schemas", "|"))


@query
def indexed_search(spark, folder):
    index = _landed(spark, folder, "grams", lambda target: grams.build_index(snapshot(spark, folder, LIVE), target))
    return grams.search_index(index, SEARCH_TEXTS).withColumn("matched_columns", F.array_join("matched_columns", "|"))


@query
def bounded_candidates(spark, folder):
    return details.bounded_candidates(resolution(spark, folder)[1])


# --- messages ----------------------------------------------------------------


@query
def scrub_all(spark, folder):
    """Every page as a message that tells secrets of other pages, scrubbed of the secrets of all pages."""
    found = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    number = F.col("page_id").cast("string")
    secrets = found.select(F.explode(F.array(F.concat(F.lit("hunter"), number), F.concat(F.lit("p@ss-w0rd!"), number), F.concat(F.lit("p%40ss-w0rd!"), number))).alias("secret"))
    other = lambda k: (F.col("page_id") + k).cast("string")
    message = F.concat(F.lit("hunter"), other(1), F.lit(" p@ss-w0rd!"), other(5), F.lit("0 hunterp%40ss-w0rd!"), other(11), F.lit(" "), F.coalesce("html", F.lit("")))
    scrubbed = scrub.scrub_all(found.select("page_id", message.alias("message")), secrets, "page_id", "message", "secret", fresh(spark, "scrubbed"))
    return scrubbed.select("page_id", F.sha2("message", 256).alias("hash"), F.length("message").alias("n_chars"))
