"""Note pages: malformed texts with their reasons, notes, lifecycle, reading files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cartulary.operators import pages
from cartulary.operators.pages import ARCHIVE_NOTE, END, START
from cartulary.sources.pages import read_pages

ID = "public.orders"
HASH, DOC = "a" * 64, "b" * 64


def front(**extra):
    return json.dumps({"version": 1, "table": ID, "purpose": "", "owner": "", "tags": [], "columns": {}, **extra})


def page(head=None, state="active"):
    return "\n".join([
        "---", front() if head is None else head, "---", "", f"# {ID}", "", START, f"<!-- state:{state} -->", f"<!-- hash:{HASH} -->",
        f"<!-- doc-hash:{DOC} -->", "Body", END, "", "## Notes", ""])


def parse(spark, texts):
    rows = [("c", ID, "public", f"p{i:03d}", text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "catalog_id string, relation_id string, schema string, path string, text string")
    return pages.parse_pages(frame).orderBy("path").collect()


def test_malformed_pages_and_fields(spark):
    good = page()
    swapped = good.replace(START, "x").replace(END, START).replace("\nx\n", f"\n{END}\n")
    cases = [
        (good, None), (good.replace("\n", "\r\n"), None),
        (good.replace(END, ""), "marks_count"), (good.replace(START + "\n", ""), "marks_count"),
        (good + f"\n{END}\n", "marks_count"), (good + f"\n{START}\n", "marks_count"),
        (swapped, "marks_order"), (good.replace(HASH, "abc"), "marks_header"),
        (good.replace("state:active", "state:gone"), "marks_header"), (good[4:], "front_absent"),
        ("---\n{}", "front_open"), (page("{bad"), "front_unreadable"), (page("[1]"), "front_kind"),
        (page('{"version":1,"version":1}'), "front_repeats"), (page(front(purpose=42)), "purpose"),
        (page(front(owner={"a": 1})), "owner"), (page(front(tags="core")), "tags"),
        (page(front(tags=[1])), "tags"), (page(front(columns=["a"])), "columns"),
        (page(front(columns={"a": "note"})), "column:a:kind"), (page(front(columns={"a": {"sensitive": "yes"}})), "column:a:sensitive"),
        (page(front(columns={"a": {"note": 1}})), "column:a:note"), (page(front(version=2)), "version"),
        (page(front(version="1")), "version"), (page(front(table="public.customers")), "table"),
        (page(front(purpose=None, tags=None, columns=None, custom={"x": [1]})), None),
    ]
    found = parse(spark, [text for text, _ in cases])
    assert [row.reason for row in found] == [reason for _, reason in cases]
    assert all(row.ok == (row.reason is None) for row in found)


def test_notes_are_read_in_order(spark):
    head = front(purpose="p", tags=["x", "y"], columns={"z": {"note": "n", "sensitive": False, "reviewer": "r"}, "__proto__": None, "a": {"sensitive": True}})
    row = parse(spark, [page(head)])[0]
    assert (row.purpose, row.tags, row.state, row.hash, row.doc_hash) == ("p", ["x", "y"], "active", HASH, DOC)
    assert [tuple(n) for n in row.column_notes] == [("z", "n", False), ("__proto__", None, None), ("a", None, True)]
    assert row.before == f"\n# {ID}\n\n" and row.after == "\n## Notes\n" and row.block == "Body\n"


def lifecycle(spark, text, captured, due, live=(HASH, DOC)):
    rows = [("c", ID, "public", "p", text)]
    frame = pages.parse_pages(spark.createDataFrame(rows, "catalog_id string, relation_id string, schema string, path string, text string"))
    subject = frame.select(
        "*", F.lit(True).alias("has_page"), F.lit(captured).alias("captured"), F.lit(due).alias("due_state"),
        F.lit(live[0]).alias("live_hash"), F.lit(live[1]).alias("live_doc_hash"))
    row = pages.lifecycle(subject).first()
    return row.action, row.new_text


def test_archive_is_idempotent_and_reversible(spark):
    text = page()
    action, removed = lifecycle(spark, text, False, "removed")
    assert action == "removed" and ARCHIVE_NOTE["removed"] in removed
    assert removed.replace(ARCHIVE_NOTE["removed"] + "\n\n", "").replace("state:removed", "state:active") == text
    assert lifecycle(spark, removed, False, "removed") == ("unchanged", removed)
    action, outside = lifecycle(spark, removed, False, "out_of_scope")
    assert action == "out_of_scope" and ARCHIVE_NOTE["removed"] not in outside and outside.count(ARCHIVE_NOTE["out_of_scope"]) == 1
    assert lifecycle(spark, outside, True, "active") == ("reactivated", text)
    action, updated = lifecycle(spark, text, True, "active", ("c" * 64, DOC))
    assert action == "updated" and updated == text.replace(HASH, "c" * 64)
    assert lifecycle(spark, text.replace(END, ""), True, "active")[0] == "skipped"


def test_read_page_files(spark, tmp_path):
    folder = tmp_path / "db1"
    folder.mkdir()
    odd = 'My "S".x'
    quoted = 'public."My ""S"".x"'
    (folder / "one.md").write_text(page())
    (folder / "two.md").write_text(page(json.dumps({"version": 1, "table": quoted})))
    (folder / "notes.md").write_text("no front block")
    (folder / "other.txt").write_text(page())
    found = {r.relation_id: (r.catalog_id, r.schema, r.text) for r in read_pages(spark, str(tmp_path)).collect()}
    assert set(found) == {ID, quoted} and odd not in found
    assert found[ID] == ("db1", "public", page())
