"""Stored things on small tables: publishing, logs, books, saved snapshots, kept sums, histories, the name index."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from model import column, foreign_key, index, relation, snapshots
from pyspark.sql import functions as F

from cartulary.operators import diff, grams, pages
from cartulary.operators.hashes import relation_hashes
from cartulary.plans import detail, discovery, incremental, page_text
from cartulary.sources import books, manifest, published, saved
from cartulary.sources.raw import checked_scopes


# --- published ---------------------------------------------------------------


def publish(spark, rows, path):
    frame = spark.createDataFrame(rows, "k string, v string")
    return {r.k: (r.written, r.removed) for r in published.publish(frame, ["k"], "v", str(path)).collect()}


def content(spark, path):
    return {r.k: r.v for r in published.published(spark, [("k", "string")], "v", str(path)).collect()}


def test_only_what_changed_is_written(spark, tmp_path):
    assert content(spark, tmp_path) == {}
    assert publish(spark, [("a", "1"), ("b", ""), ("c", None)], tmp_path) == {"a": (True, False), "b": (True, False), "c": (True, False)}
    assert publish(spark, [("a", "1"), ("b", None), ("d", "4")], tmp_path) == {"a": (False, False), "b": (True, False), "c": (False, True), "d": (True, False)}
    assert content(spark, tmp_path) == {"a": "1", "b": None, "d": "4"}


def test_a_second_run_writes_no_version(spark, tmp_path):
    publish(spark, [("a", "1")], tmp_path)
    before = {str(p) for folder in ("data", "manifests", "heads") for p in (tmp_path / folder).rglob("*")}
    assert publish(spark, [("a", "1")], tmp_path) == {"a": (False, False)}
    assert {str(p) for folder in ("data", "manifests", "heads") for p in (tmp_path / folder).rglob("*")} == before


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    publish(spark, [("a", "1")], tmp_path)
    whole = spark.createDataFrame

    def dies(data, schema=None, *more, **named):
        if schema == published._HEAD and data:
            raise RuntimeError("killed")
        return whole(data, schema, *more, **named)

    frame = whole([("a", "2"), ("b", "3")], "k string, v string")
    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        published.publish(frame, ["k"], "v", str(tmp_path))
    monkeypatch.undo()
    assert content(spark, tmp_path) == {"a": "1"}
    assert publish(spark, [("a", "2"), ("b", "3")], tmp_path) == {"a": (True, False), "b": (True, False)}
    assert content(spark, tmp_path) == {"a": "2", "b": "3"}


def test_a_run_logs_once(spark, tmp_path):
    lines = spark.createDataFrame([("db", "x"), ("dc", "y")], "catalog_id string, line string")
    for run in ("1", "1", "2"):
        published.append_once(lines, str(tmp_path), run)
    published.append_once(lines.withColumn("line", F.lit("z")), str(tmp_path), "2")
    found = spark.read.schema("catalog_id string, line string, run_id string").parquet(str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [("db", "x", "1"), ("db", "z", "2"), ("dc", "y", "1"), ("dc", "z", "2")]
    with pytest.raises(ValueError):
        published.append_once(lines, str(tmp_path), "")


# --- books -------------------------------------------------------------------

PAGE = "catalog_id string, relation_id string, schema string, path string, text string"


def test_books_keep_every_character(spark, tmp_path):
    texts = ["", "\n", "a\r\nb\n\n", "é  日本\x85", "x" * 300_000, '{"a": "b"}']
    rows = [(f"db{i % 2}", f'public."t{i}"', "public", f"p/{i}.md", t) for i, t in enumerate(texts)]
    refused = books.write_books(spark.createDataFrame([*rows, ("db0", "t", "s", "bad", "a\x1eb")], PAGE), str(tmp_path), 2)
    assert [r.path for r in refused.collect()] == ["bad"]
    back = books.read_books(spark, str(tmp_path))
    assert sorted(map(tuple, back.drop("changed_at").collect())) == sorted(rows)


def test_books_since(spark, tmp_path):
    one = [("db", "t", "s", "p1", "first")]
    books.write_books(spark.createDataFrame(one, PAGE), str(tmp_path / "1"))
    time.sleep(1.1)
    moment = datetime.now()
    time.sleep(1.1)
    books.write_books(spark.createDataFrame([("db", "t", "s", "p2", "second")], PAGE), str(tmp_path / "2"))
    assert [books.read_books(spark, str(tmp_path / n), moment).count() for n in "12"] == [0, 1]
    assert [books.read_books(spark, str(tmp_path / n)).count() for n in "12"] == [1, 1]


# --- saved snapshots, kept sums ----------------------------------------------


def tables(spark, **parts):
    return snapshots(spark, {"c": parts})


def shop(n: int = 30) -> dict:
    names = [f"t{i}" for i in range(n)]
    return {
        "relations": [relation("hub"), *(relation(t, comment="it's \"x\"\n") for t in names)],
        "columns": [column("hub", 1, "id"), *(column(t, i, c) for t in names for i, c in enumerate(("id", "hub_id"), 1))],
        "foreign_keys": [foreign_key(t, ["hub_id"], "public.hub") for t in names],
        "indexes": [index("hub", "i1", ["id"]), index("t1", "i2", [(None, "lower(a)")])]}


def test_a_hub_becomes_parts_and_comes_back(spark, tmp_path):
    made = tables(spark, **shop())
    docs = saved.documents(made, size=7).collect()
    hub = sorted((d for d in docs if d.relation_id == "public.hub"), key=lambda d: d.part)
    assert [d.part for d in hub] == list(range(5)) and {d.parts for d in hub} == {5}
    assert [d.head is not None for d in hub] == [True, False, False, False, False]
    assert all(sum(len(d[c]) for c in saved.CHILDREN) <= 7 for d in docs)
    order = [r.from_relation for d in hub for r in d.referenced_by]
    assert order == sorted(order) and len(order) == 30
    saved.export(made, str(tmp_path / "a"), size=7)
    back, findings = saved.load(spark, str(tmp_path / "a"), {n: f.schema for n, f in made.items()}, str(tmp_path / "r"))
    assert findings.count() == 0
    assert sorted(map(tuple, relation_hashes(back).collect())) == sorted(map(tuple, made["hashes"].collect()))
    assert sorted(map(str, back["referenced_by"].collect())) == sorted(map(str, made["referenced_by"].select(*back["referenced_by"].columns).collect()))


def test_only_large_relations_are_numbered(spark, tmp_path, monkeypatch):
    """Children of relations that are one document are grouped at once; saved text may be compressed."""
    made, seen = tables(spark, **shop()), []
    number = saved.number_within
    monkeypatch.setattr(saved, "number_within", lambda rows, *rest: seen.append(rows) or number(rows, *rest))
    docs = saved.documents(made, size=7)
    assert {r.relation_id for r in seen[0].select("relation_id").distinct().collect()} == {"public.hub"}
    order = {(d.relation_id, d.part): [c.name for c in d.columns] for d in docs.collect()}
    assert order["public.t3", 0] == ["id", "hub_id"] and len(order) == 35
    saved.export(made, str(tmp_path / "a"), size=7, compression="gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / "a" / "relations").rglob("part-*"))
    back, findings = saved.load(spark, str(tmp_path / "a"), {n: f.schema for n, f in made.items()}, str(tmp_path / "r"))
    assert findings.count() == 0 and sorted(map(tuple, relation_hashes(back).collect())) == sorted(map(tuple, made["hashes"].collect()))


def test_equal_snapshots_give_equal_text(spark, tmp_path):
    made = tables(spark, **shop(5))
    for place, parts in (("a", 1), ("b", 4)):
        saved.export({n: f.repartition(parts) for n, f in made.items()}, str(tmp_path / place))
    text = lambda place: "".join(p.read_text() for p in sorted((tmp_path / place / "relations").rglob("part-*")))
    assert text("a") == text("b") != ""


@pytest.mark.parametrize("damage, flaws", [
    (lambda d: "{", ["unreadable", "part_missing"]), (lambda d: "null", ["unreadable", "part_missing"]), (lambda d: json.dumps({**d, "part": "x"}), ["unreadable", "part_missing"]),
    (lambda d: json.dumps({**d, "relation_id": None}), ["no_identity", "part_missing"]), (lambda d: json.dumps({**d, "part": 9}), ["part_outside", "part_missing"]),
    (lambda d: json.dumps({**d, "head": {**d["head"], "kind": "sequence"}}), ["kind_unknown", "part_missing"]),
    (lambda d: json.dumps({**d, "columns": [{**d["columns"][0], "ordinal": None}]}), ["child_incomplete", "part_missing"]),
    (lambda d: json.dumps({**d, "columns": None}), ["child_incomplete", "part_missing"]),
    (lambda d: json.dumps({**d, "columns": [{**d["columns"][0], "type": "changed"}]}), ["content_changed"])])
def test_one_bad_document_stops_nothing(spark, tmp_path, damage, flaws):
    made = tables(spark, **shop())
    saved.export(made, str(tmp_path / "a"), size=7)
    broken, n = 0, 0
    for path in (tmp_path / "a" / "relations").rglob("part-*"):
        rows = path.read_text().splitlines()
        for i, line in enumerate(rows):
            doc = json.loads(line)
            if doc["relation_id"] == "public.hub" and doc["part"] == 0:
                rows[i], broken = damage(doc), broken + 1
        path.write_text("\n".join(rows) + "\n")
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        n += len(rows)
    assert broken == 1 and n > 30
    back, findings = saved.load(spark, str(tmp_path / "a"), {n: f.schema for n, f in made.items()}, str(tmp_path / "r"))
    assert sorted(r.flaw for r in findings.collect()) == sorted(flaws)
    assert {r.relation_id for r in back["relations"].collect()} == {f"public.t{i}" for i in range(30)}
    assert back["columns"].filter("relation_id = 'public.hub'").count() == 0


def test_kept_sums_follow_changes(spark):
    before = shop()
    after = shop()
    after["columns"] = [c for c in after["columns"] if c != column("t3", 2, "hub_id")] + [column("hub", 2, "more"), column("t4", 3, "s", enum="public.status")]
    after["relations"] = [r for r in after["relations"] if r != relation("t5", comment="it's \"x\"\n")]
    after["columns"] = [c for c in after["columns"] if c not in (column("t5", 1, "id"), column("t5", 2, "hub_id"))]
    after["foreign_keys"] = [f for f in after["foreign_keys"] if f != foreign_key("t5", ["hub_id"], "public.hub")]
    after["enums"] = [("public.status", "public", "status", ["a", "b"], False)]
    old, new = tables(spark, **before), tables(spark, **after)
    changes = incremental.changed_tables(old, new)
    where = new["relations"].select("snapshot_id").first()[0]
    lanes = incremental.refresh_lanes(incremental.section_lanes(old), changes, where)
    found = incremental.hashes_from_lanes(lanes, new["relations"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, new["hashes"].select(*found.columns).collect()))
    counts = {(r.relation_id, r.part): (r.came, r.gone) for r in incremental.change_counts(changes).collect()}
    assert counts[("public.t3", "columns")] == (0, 1) and counts[("public.hub", "columns")] == (1, 0) and ("public.t9", "columns") not in counts


def test_history_with_gaps(spark):
    rows = [("c", f"s{i}", "t", h) for i, h in enumerate("aab.ba") if h != "."] + [("c", "s3", "u", "x"), ("d", "s0", "t", "a")]
    frame = spark.createDataFrame(rows, "catalog_id string, snapshot_id string, relation_id string, hash string")
    found = sorted(map(tuple, diff.history_intervals(frame, frame).collect()))
    assert found == [("c", "t", "a", "s0", "s2", 2), ("c", "t", "a", "s5", None, 1), ("c", "t", "b", "s2", "s3", 1), ("c", "t", "b", "s4", "s5", 1), ("c", "u", "x", "s3", "s4", 1), ("d", "t", "a", "s0", None, 1)]


# --- extracts, names, texts --------------------------------------------------


def test_torn_extracts(spark):
    raw = {n: spark.createDataFrame([("c", "s1", 1), ("c", "s1", 2), ("d", "s1", 1)], "catalog_id string, snapshot_id string, x int") for n in ("relations", "types")}
    whole = [(c, "s1", n, k, "m") for c, k in (("c", 2), ("d", 1)) for n in raw]
    schema = "catalog_id string, snapshot_id string, part string, rows long, mark string"
    told = lambda rows: sorted((r.catalog_id, r.flaw) for r in manifest.extract_findings(raw, spark.createDataFrame(rows, schema)).collect())
    assert told(whole) == []
    assert told([*whole[:3], ("d", "s1", "types", 1, "other")]) == [("d", "several_moments")]
    assert told([*whole[:3], ("d", "s1", "types", 1, None)]) == [("d", "several_moments")]
    assert told(whole[:3]) == [("d", "table_unlisted")]
    assert told([("c", "s1", "relations", 3, "m"), *whole[1:]]) == [("c", "rows_differ")]
    assert told([*whole, ("c", "s1", "indexes", 0, "m")]) == [] and told([*whole, ("c", "s1", "indexes", 1, "m")]) == [("c", "rows_differ")]
    findings = manifest.extract_findings(raw, spark.createDataFrame(whole[:3], schema))
    assert {r.catalog_id for r in manifest.whole_extracts(raw, findings)["types"].collect()} == {"c"}


def test_scopes(spark):
    rows = [("a", "s", "x", 2), ("a", "s", "y", 1), ("b", "s", "x", 1), ("b", "s", "x", 2), ("c", "s", "", 1), ("d", "s", None, 1)]
    schema = "catalog_id string, snapshot_id string, schema string, position int"
    every = spark.createDataFrame([*rows, ("e", "s", "", 1)], schema)
    found = {r.catalog_id: (r.schemas, r.flaw) for r in checked_scopes(spark.createDataFrame(rows, schema), every).collect()}
    assert found == {"a": (["y", "x"], None), "b": (["x", "x"], "repeated_name"), "c": ([""], "empty_name"), "d": ([""], "empty_name"), "e": (["public"], None)}


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    made = tables(spark, relations=[relation("Order Items"), relation("ab"), relation("ünïcode")], columns=[
        column("ab", 1, "a"), column("ab", 2, "aa"), column("ab", 3, "aaa"), column("Order Items", 1, "E-MAIL"), column("Order Items", 2, "order_id"), column("ünïcode", 1, "日本語")])
    index_of = grams.build_index(made, str(tmp_path))
    texts = ["a", "aa", "aaaa", " order ", "E-mail", "public.ab", "ï", "日本", "%", "_", "ab", "zz"]
    row = lambda r: (r.catalog_id, r.relation_id, r.text, r["rank"], tuple(r.matched_columns))
    assert sorted(map(row, grams.search_index(index_of, texts).collect())) == sorted(map(row, discovery.search(made, texts).collect()))
    plan = grams.search_index(index_of, ["order"])._jdf.queryExecution().toString()
    assert "folder IN" in plan.replace("folder#", "folder ").replace("  ", " ") or "PartitionFilters: [" in plan
    with pytest.raises(ValueError):
        grams.search_index(index_of, ["  "])


def test_page_texts_in_parts(spark):
    made = tables(spark, **shop())
    overrides = spark.createDataFrame([], "catalog_id string, relation_id string, name string, sensitive boolean")
    whole = {r.relation_id: r.text for r in page_text.page_texts(made, overrides, 1000).collect()}
    parts = page_text.page_texts(made, overrides, 4).collect()
    for relation_id, text in whole.items():
        own = sorted((r for r in parts if r.relation_id == relation_id), key=lambda r: r.part)
        assert "".join(r.text for r in own) == text and all(r.n_lines <= 4 and r.parts == len(own) for r in own)
    first = {r.relation_id: r.rendered for r in page_text.first_texts(page_text.page_texts(made, overrides, 4)).collect()}
    assert first["public.hub"].endswith(f"- parts: {-(-len(whole['public.hub'].splitlines()) // 4)}\n")


def test_refresh_renders_all_parts(spark):
    made = tables(spark, **shop())
    overrides = spark.createDataFrame([], "catalog_id string, relation_id string, name string, sensitive boolean")
    whole = {r.relation_id: r.text for r in page_text.page_texts(made, overrides, 1000).collect()}
    none = spark.createDataFrame([], "catalog_id string, relation_id string, schema string, path string, text string")
    subject = pages.subjects(made["hashes"], pages.parse_pages(none), made["scopes"])
    found = page_text.refreshed(subject, page_text.page_texts(made, overrides, 4)).collect()
    text = {r.relation_id: r.new_text for r in found}
    assert set(text) == set(whole) and len(found) == len(whole) and len(whole["public.hub"].splitlines()) > 8
    for relation_id, lines in whole.items():
        assert text[relation_id].endswith(f" -->\n{lines}{pages.END}\n")


def test_candidates_are_bounded(spark):
    rows = [("c", "r", 1, f"t{i:02}") for i in range(25)] + [("c", "r", 2, "x")]
    found = detail.bounded_candidates(spark.createDataFrame(rows, "catalog_id string, request_id string, pos int, candidate string")).collect()
    assert len(found) == 21 and {(r.pos, r.omitted) for r in found} == {(1, 5), (2, 0)}
    assert max(r.candidate for r in found if r.pos == 1) == "t19"
