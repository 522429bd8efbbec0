"""A harbour's catalog from raw extracts to detail lines, and stores."""

from __future__ import annotations

import pytest
from model import column, foreign_key, relation, snapshot
from pyspark.sql import functions as F

from cartulary.operators import hashes as hashing
from cartulary.operators import lines
from cartulary.plans import detail, reports
from cartulary.plans.capture import capture
from cartulary.sources import raw as raw_source
from cartulary.sources import sinks
from cartulary.sources.store import at

SCHEMAS = {1: "port", 2: "registry", 3: "archive"}
ENUMS = {50: (1, "cargo_class", ["dry", "wet", "reefer"]), 51: (2, "flag", ["MT", "PA"]), 52: (1, "signal", ["day", "night"]), 53: (1, "unused_mark", ["x"]), 54: (3, "elsewhere", ["y"])}
TYPES = {"text": 40, "signals": 45, "cargo_class": 50, "flag": 51}


def rel(oid, name, columns, schema=1, kind="r", comment=None, estimate=-1.0, child=False, constraints=(), indexes=()):
    """One relation: columns as ``(name, type text, options)``, in order of their numbers."""
    return {"oid": oid, "name": name, "columns": columns, "schema": schema, "kind": kind, "comment": comment, "estimate": estimate, "child": child, "constraints": constraints, "indexes": indexes}


def key(name, kind, numbers, definition, index=0, **target):
    return {"name": name, "kind": kind, "numbers": numbers, "definition": definition, "index": index, "to": 0, "their": None, "delete": " ", "update": " ", "late": False, **target}


HARBOUR = [
    rel(20, "berths", [("code", "text", {"need": 1}), ("depth_cm", "integer", {"need": 1, "default": "0"}), ("gone", "text", {"dropped": 1}), ("lamp_signals", "port.signal[]", {"need": 1, "default": "'{}'::port.signal[]", "kind": "signals"}),
                       ("owner_id", "bigint", {})], comment="Places to moor", estimate=7.5,
        constraints=[key("berths_pkey", "p", [1], "PRIMARY KEY (code)", 301), key("berths_depth_cm_key", "u", [2], "UNIQUE (depth_cm)", 302),
                     key("berths_owner_id_fkey", "f", [5], "FOREIGN KEY (owner_id) REFERENCES registry.owners(id)", to=29, their=[1], delete="a", update="a")],
        indexes=[(301, "berths_pkey", True, True, [1], None, "(code)"), (302, "berths_depth_cm_key", True, True, [2], None, "(depth_cm)"), (303, "berths_upper_idx", False, True, [0], "upper(code)", "(upper(code))")]),
    rel(21, "tugs", [("id", "bigint", {"need": 1, "identity": "a"}), ("call_sign", "text", {"need": 1}), ("pull_kn", "integer", {"need": 1}), ("pull_t", "integer", {"computed": "(pull_kn / 10)"}),
                     ("flag", "registry.flag", {"need": 1, "default": "'MT'::registry.flag", "kind": "flag"})], estimate=float("nan"),
        constraints=[key("tugs_pkey", "p", [1], "PRIMARY KEY (id)"), key("tugs_call_sign_key", "u", [2], "UNIQUE (call_sign)")]),
    rel(22, "moorings", [("id", "uuid", {"need": 1, "default": "new_id()"}), ("berth_code", "text", {"need": 1}), ("agent_phone", "text", {"need": 1}),
                         ("cargo", "port.cargo_class", {"need": 1, "default": "'dry'::port.cargo_class", "kind": "cargo_class"})],
        constraints=[key("moorings_pkey", "p", [1], "PRIMARY KEY (id)"), key("moorings_berth_code_fkey", "f", [2], "FOREIGN KEY (berth_code) REFERENCES port.berths(code)", to=20, their=[1], delete="a", update="a")],
        indexes=[(304, "moorings_cargo_idx", False, True, [4, 2], None, "(cargo) INCLUDE (berth_code)"), (305, "half_built", True, False, [3], None, "(agent_phone)")]),
    rel(23, "tows", [("mooring_id", "uuid", {"need": 1}), ("tug_id", "bigint", {"need": 1}), ("metres", "integer", {"need": 1})],
        constraints=[key("tows_pkey", "p", [1, 2], "PRIMARY KEY (mooring_id, tug_id)"), key("tows_some_way", "c", [3], "CHECK (metres > 0)"),
                     key("tows_mooring_id_fkey", "f", [1], "FOREIGN KEY (mooring_id) REFERENCES port.moorings(id) ON DELETE CASCADE", to=22, their=[1], delete="c", update="a")]),
    rel(24, "tow_damages", [("id", "bigint", {"need": 1, "identity": "d"}), ("mooring_id", "uuid", {"need": 1}), ("tug_id", "bigint", {"need": 1})],
        constraints=[key("damage_of_tow", "f", [2, 3], "FOREIGN KEY (mooring_id, tug_id) REFERENCES port.tows(mooring_id, tug_id) ON UPDATE CASCADE DEFERRABLE INITIALLY DEFERRED", to=23, their=[1, 2], delete="a", update="c", late=True)],
        indexes=[(306, "damage_by_tug", False, True, [3, 2], None, "(tug_id, mooring_id)")]),
    rel(25, "tides", [("at", "timestamp with time zone", {"need": 1})], kind="p"), rel(30, "tides_spring", [("at", "timestamp with time zone", {"need": 1})], child=True),
    rel(26, "berth_use", [("mooring_id", "uuid", {})], kind="v", estimate=3.0),
    rel(27, "Moorings", [("id", "integer", {"need": 1})], constraints=[key("Moorings_pkey", "p", [1], "PRIMARY KEY (id)")]),
    rel(28, 'pilot.log ß "b"', [("Free Text", "text", {}), ("ref.no", "integer", {})],
        constraints=[key("logged", "f", [2], 'FOREIGN KEY ("ref.no") REFERENCES port."Moorings"(id)', to=27, their=[1], delete="a", update="a")]),
    rel(29, "owners", [("id", "bigint", {"need": 1})], schema=2), rel(31, "bills", [("id", "bigint", {})], schema=3), rel(32, "next_tow", [], kind="S"),
]


def extracts(spark):
    k = ("c", "s1")
    names = {r["oid"]: f'{SCHEMAS[r["schema"]]}.{r["name"]}' for r in HARBOUR}
    columns = [(r, n, name, text, o) for r in HARBOUR for n, (name, text, o) in enumerate(r["columns"], 1)]
    hidden = [(HARBOUR[0], -1, "xmin", "xid", {"need": 1})]
    rows = {
        "scopes": [(*k, "port", 1)],
        "namespaces": [(*k, number, name) for number, name in SCHEMAS.items()],
        "relations": [(*k, r["oid"], r["schema"], r["name"], r["kind"], r["estimate"], r["comment"], " SELECT m.id AS mooring_id FROM moorings m;\n", "RANGE (at)", r["child"]) for r in HARBOUR],
        "attributes": [
            (*k, r["oid"], n, name, TYPES[o.get("kind", "text")], text, "need" in o, "s" if "computed" in o else "", o.get("computed", o.get("default")), o.get("identity", ""), None, "dropped" in o)
            for r, n, name, text, o in columns + hidden],
        "types": [(*k, 40, 1, "text", "b", "S", 0), (*k, 45, 1, "_signal", "b", "A", 52)] + [(*k, o, n, t, "e", "E", 0) for o, (n, t, _) in ENUMS.items()],
        "enum_labels": [(*k, o, float(len(v) - i), label) for o, (_, _, v) in ENUMS.items() for i, label in enumerate(reversed(v))],
        "constraints": [
            (*k, c["name"], r["oid"], c["kind"], c["numbers"], c["to"], c["their"], c["delete"], c["update"], "s", c["late"], c["late"], True, c["index"], 0, c["definition"]) for r in HARBOUR for c in r["constraints"]],
        "indexes": [
            (*k, oid, r["oid"], name, "btree", unique, name.endswith("_pkey"), valid, 1 if "INCLUDE" in over else len(places), places, [expression or over.strip("()").split(",")[0]] * len(places), None,
             f"CREATE {'UNIQUE ' if unique else ''}INDEX {name} ON {names[r['oid']]} USING btree {over}")
            for r in HARBOUR for oid, name, unique, valid, places, expression, over in r["indexes"]],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in raw_source.SCHEMAS.items()}


@pytest.fixture(scope="module")
def harbour(spark, tmp_path_factory):
    return capture(extracts(spark), str(tmp_path_factory.mktemp("harbour")))


def test_captured_relations_and_enums(harbour):
    rows = {r.relation_id: r for r in harbour["relations"].collect()}
    assert set(rows) == {f"port.{n}" for n in ("berths", "tugs", "moorings", "tows", "tow_damages", "tides", "berth_use", '"Moorings"', '"pilot.log ß ""b"""')}
    assert [rows[f"port.{n}"].row_estimate for n in ("berths", "tugs", "moorings", "berth_use")] == [8, None, None, None]
    assert (rows["port.tides"].kind, rows["port.tides"].partition_key) == ("partitioned_table", "RANGE (at)")
    enums = {r.enum_id: (r["values"], r.external) for r in harbour["enums"].collect()}
    assert enums == {"port.cargo_class": (["dry", "wet", "reefer"], False), "registry.flag": (["MT", "PA"], True), "port.signal": (["day", "night"], False), "port.unused_mark": (["x"], False)}
    signals = harbour["columns"].filter("name = 'lamp_signals'").first()
    assert (signals.enum_id, signals.ordinal) == ("port.signal", 3)


LINES = {
    ("moorings", "columns"): ["id uuid; primary key; default new_id()", "berth_code text; required; to port.berths.code", "agent_phone text; required; sensitive", "cargo port.cargo_class; required; default 'dry'"],
    ("tugs", "columns"): ["id bigint; primary key; identity always", "call_sign text; required; unique", "pull_kn integer; required", "pull_t integer; computed (pull_kn / 10)", "flag registry.flag; required; default 'MT'"],
    ('"pilot.log ß ""b"""', "columns"): ['"Free Text" text', '"ref.no" integer; to port."Moorings".id named logged'],
    ("tows", "columns"): ["mooring_id uuid; required; to port.moorings.id on delete cascade", "tug_id bigint; required", "metres integer; required"],
    ("tows", "key"): ["tows_pkey (mooring_id, tug_id)"], ("tows", "check"): ["tows_some_way = CHECK (metres > 0)"], ("tows", "used_by"): ["port.tow_damages (mooring_id, tug_id)"],
    ("tow_damages", "foreign"): ["damage_of_tow (mooring_id, tug_id) to port.tows (mooring_id, tug_id); on update cascade; deferrable; initially deferred"],
    ("moorings", "index"): ["half_built (agent_phone); unique; unusable", "moorings_cargo_idx (cargo) INCLUDE (berth_code)"], ("berths", "index"): ["berths_upper_idx (upper(code))"],
    ("berth_use", "view"): ["SELECT m.id AS mooring_id FROM moorings m;"]}


def test_lines(harbour, spark):
    none = spark.createDataFrame([], "catalog_id string, relation_id string, name string, sensitive boolean")
    found = {}
    for r in lines.all_lines(harbour, none).orderBy("relation_id", "section", "ordinal", "order_key").collect():
        found.setdefault((r.relation_id.removeprefix("port."), r.section), []).append(r.line)
    assert {k: found.get(k) for k in LINES} == LINES


def test_a_human_answer_wins(harbour, spark):
    said = spark.createDataFrame([("c", "port.moorings", "agent_phone", False), ("c", "port.tugs", "call_sign", True)], "catalog_id string, relation_id string, name string, sensitive boolean")
    found = {r.line for r in lines.column_lines(harbour, said).collect()}
    assert {"agent_phone text; required", "call_sign text; required; unique; sensitive"} <= found


def test_definitions_that_say_more(spark):
    """What the fields do not tell is kept as the server printed it."""
    more = "FOREIGN KEY (a) REFERENCES public.parent(id) ON DELETE SET NULL (a)"
    made = snapshot(spark, relations=[relation("t")], columns=[column("t", 1, "a")], foreign_keys=[foreign_key("t", ["a"], name="f", definition=more)])
    assert [r.line for r in lines.foreign_key_lines(made).collect()] == [f"f = {more}"]


def test_neighbours_external_and_names(harbour, spark):
    requests = spark.createDataFrame(
        [("c", 1, 0, "moorings"), ("c", 1, 1, "Port.Berths"), ("c", 1, 2, "moorings"), ("c", 2, 0, '"Moorings"'), ("c", 2, 1, '"MOORINGS"'), ("c", 2, 2, "x.y.z")],
        "catalog_id string, request_id int, pos int, input string")
    known = harbour["relations"].select("catalog_id", "relation_id", "name")
    resolved, candidates = detail.resolve_names(requests, known, harbour["scopes"])
    assert [r.code for r in resolved.orderBy("request_id", "pos").collect()] == ["ok", "ok", "ok", "ok", "unknown_relation", "invalid_name"]
    assert {r.candidate for r in candidates.collect()} == {'port."Moorings"', "port.moorings"}
    assert [(r.request_id, r.code) for r in detail.first_problems(resolved).collect()] == [(2, "unknown_relation")]
    assert [(r.request_id, r.code) for r in detail.first_problems(resolved, 1).orderBy("request_id").collect()] == [(1, "too_many_relations"), (2, "unknown_relation")]
    assert detail.accepted(resolved, 1).count() == 0
    accepted = detail.accepted(resolved)
    assert [r.relation_id for r in accepted.orderBy("pos").collect()] == ["port.moorings", "port.berths"]
    chosen = detail.selection(harbour, accepted, related=True)
    assert [r.relation_id for r in chosen.orderBy("is_neighbor", "pos").collect()] == ["port.moorings", "port.berths", "port.tows"]
    assert [r.ref for r in detail.detail_external(harbour, chosen).collect()] == ["registry.owners"]


def test_json_export_round_trip(harbour, spark, tmp_path):
    sinks.export_json(harbour, str(tmp_path / "json"))
    schemas = {"relations": sinks.nested_relations(harbour).schema, **{n: harbour[n].schema for n in ("enums", "snapshots", "scopes")}}
    again = sinks.import_json(spark, str(tmp_path / "json"), schemas)
    recomputed = hashing.relation_hashes(again).select("relation_id", "hash", "doc_hash")
    want = {tuple(r) for r in harbour["hashes"].select("relation_id", "hash", "doc_hash").collect()}
    assert {tuple(r) for r in recomputed.collect()} == want
    stored = again["snapshots"].select("*", F.lit(2).alias("format"), F.lit("pg-catalog-v1").alias("coverage"))
    assert all(r.ok for r in reports.snapshot_checks(again, stored).collect())


def test_capture_twice_is_equal(harbour, spark, tmp_path):
    again = capture(extracts(spark), str(tmp_path))
    assert again["snapshots"].select("revision").collect() == harbour["snapshots"].select("revision").collect()
    assert at(again, "s2")["relations"].count() == 0


def test_changed_rows_only_and_log(spark, tmp_path):
    stored = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "path string, text string")
    assert {r.path for r in sinks.changed(new, stored, ["path"], "text").collect()} == {"b", "c"}
    for _ in range(2):
        sinks.append_log(new.select("path"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_scope_list(spark):
    assert [r.schema for r in raw_source.scope_list(spark, None, "c", "s").collect()] == ["public"]
    for bad in ([], ["a", "a"], [""], ["a\0"]):
        with pytest.raises(ValueError):
            raw_source.scope_list(spark, bad, "c", "s")


def test_element_quantiles_do_not_interpolate(spark):
    rows = spark.range(30).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    row = reports.latency_summary(rows, ["g"], "v", {"median": 0.5, "p95": 0.95}).first()
    assert (row.n, row.minimum, row.median, row.p95) == (30, 0.0, 15.0, 28.0)


def test_wide_relations_keep_their_order(spark):
    """Columns beyond 99,999 keep distinct places in order."""
    numbers = (9, 99_999, 100_000, 123_451, 123_456)
    wide = snapshot(spark, relations=[relation("wide")], columns=[column("wide", n, f"c_{n}") for n in numbers])
    none = spark.createDataFrame([], "catalog_id string, relation_id string, name string, sensitive boolean")
    found = lines.column_lines(wide, none).orderBy("ordinal").collect()
    assert [r.line for r in found] == [f"c_{n} text" for n in numbers]
