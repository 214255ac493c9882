"""Facts, flows, cards, pages and case diagnosis on the fixture."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import diagnose, joins, rules
from ledgerloom.plans import cards, flows, render
from ledgerloom.sources import facts as fact_source
from ledgerloom.sources import pages as page_source
from ledgerloom.sources import snapshots

DATA = Path(__file__).parent / "data"
PRINT, REGISTER = "T:Ship.PrintLabelCommandHandler", "T:Ship.RegisterParcelCommandHandler"


@pytest.fixture(scope="module")
def facts(spark):
    return fact_source.load(spark, str(DATA / "facts.json"))


def test_flatten(facts):
    assert facts.entries.count() == 8
    row = facts.guards.where(f"entry_id = '{PRINT}' AND guard_id = 'G2'").first()
    assert (row.pos, row.path, row.line, row.kind) == (1, "src/Print.cs", 14, "filter")
    assert [r.event for r in facts.raised.collect()] == ["T:Ship.ParcelRegistered"]
    assert fact_source.number_guards(facts.guards).where(f"entry_id = '{PRINT}' AND pos = 5").first().guard_id == "G6"
    assert fact_source.entry_hashes(facts).select("hash").distinct().count() == facts.entries.join(facts.edges.select("entry_id"), "entry_id", "left_semi").count() + 1


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    with pytest.raises(Exception):
        fact_source.load(spark, str(tmp_path / "e.json"))
    assert fact_source.manifest(spark, str(tmp_path / "none.json"), optional=True).count() == 0
    assert fact_source.glossary(spark, str(tmp_path / "none.json")).count() == 0


def test_table_and_column_names(spark):
    entities = spark.createDataFrame([("Order",), ("HTTPLog",), ("Plain",)], "entity string")
    tables = fact_source.resolve_tables(entities, spark.createDataFrame([("Order", "t_orders")], "entity string, table string"), spark.createDataFrame([("HTTPLog", "HTTPLogs"), ("Order", "Orders")], "entity string, set_name string"))
    assert {r.entity: r.table for r in tables.collect()} == {"Order": "t_orders", "HTTPLog": "http_logs", "Plain": None}
    fields = spark.createDataFrame([("Order", "FirstName", None), ("Plain", "FirstName", None)], "entity string, name string, column string")
    named = fact_source.resolve_columns(fields, tables, spark.createDataFrame([], "entity string, name string, column string"))
    assert {r.entity: r.column for r in named.collect()} == {"Order": "first_name", "Plain": None}


def test_flow(facts):
    steps = {(r.flow_id, r.no): r for r in flows.discover(facts).collect()}
    flow = "flow:POST /parcels"
    assert [steps[flow, n].entry_id or steps[flow, n].external for n in range(1, 6)] == [REGISTER, "T:Ship.ParcelRegisteredEventHandler", PRINT, "T:Ext.CallCourier", "T:Ship.DeliverParcelCommandHandler"]
    assert [steps[flow, n].parent_no for n in range(1, 6)] == [None, 1, 2, 3, 4]
    assert [steps[flow, n].dashed for n in range(1, 6)] == [False] * 4 + [True]
    assert {f for f, _ in steps} == {flow}


def test_diagram(facts):
    steps = flows.discover(facts)
    titles = cards.use_cases(facts).select(F.col("page_id").alias("entry_id"), "title")
    nodes, edges = flows.diagram(steps, facts.guards, titles)
    labels = {r.id: (r.label, r.shape) for r in nodes.collect()}
    assert labels["A"] == ("Register parcel", "step") and labels["C"] == ("parcel.Kind == ParcelKind.Letter?", "decision")
    got = {(r.src, r.dst, r.label) for r in edges.collect()}
    assert {("A", "B", None), ("B", "C", None), ("C", "D", "yes"), ("C", "E", "no")} <= got
    stops = {(r.kind, r.what) for r in flows.silent_stops(steps, facts.guards, facts.edges).collect()}
    assert ("swallowed", "T:Ship.PrintLabel") in stops and ("guard", "parcel.Kind == ParcelKind.Letter") in stops


def test_silent_stops(facts, spark):
    steps = flows.discover(facts)
    got = {(r.no, r.kind, r.what, r.rule) for r in flows.silent_stops(steps, facts.guards, facts.edges, cards.rules(facts), facts.transitions).collect()}
    assert got == {
        (2, "guard", "parcel.Kind == ParcelKind.Letter", 1), (3, "guard", '!flags.IsEnabledAsync("Labels")', 1),
        (2, "swallowed", "T:Ship.PrintLabel", None), (3, "swallowed", "T:Ext.CallCourier", None),
        (5, "final_status", "Parcel.Status = Failed", None),
    }
    steps = spark.createDataFrame([("f", 1, "e"), ("f", 2, None)], "flow_id string, no int, entry_id string")
    guards = spark.createDataFrame([("e", i, f"G{i}", f"c{i}", x) for i, x in enumerate(["return", "silent_success", "return", "fail:X", "return", "return"])], "entry_id string, pos int, guard_id string, condition string, exit string")
    rules_ = spark.createDataFrame([("e", 2, ["G1", "G4"], "second"), ("e", 1, ["G0", "G1", "G3"], "first"), ("other", 1, ["G2"], "not of e")], "entry_id string, no int, guard_ids array<string>, conditions string")
    edges = spark.createDataFrame([("e", i, "writes", t, d) for i, (t, d) in enumerate([("Order.Status", "S.Rejected"), ("T:X.Order", "Error"), ("Order.Status", "S.Cancelled"), ("Order.Status", None), ("Order.Status", "S.Paid"), ("Bill.Status", "S.Rejected")])], "entry_id string, pos int, type string, target string, detail string")
    transitions = spark.createDataFrame([("Order", None, "Rejected"), ("Order", "Open", "Error"), ("Order", "Open", "Cancelled"), ("Order", "Cancelled", "Open"), ("Order", "Open", "Paid")], "entity string, from_state string, to_state string")
    got = sorted((r.kind, r.what, r.rule) for r in flows.silent_stops(steps, guards, edges, rules_, transitions).collect())
    assert got == [("final_status", "Order.Status = Rejected", None), ("final_status", "T:X.Order = Error", None), ("guard", "c2, c5", None), ("guard", "first", 1), ("guard", "second", 2)]


def test_rules_of_cards(facts):
    got = {(r.entry_id, r.no): r for r in cards.rules(facts).collect()}
    assert (REGISTER, 1) in got and got[REGISTER, 1].on_fail == "Refused with `TooHeavy`."  # the technical id is gone
    assert got[PRINT, 1].guard_ids == ["G1"] and got[PRINT, 2].guard_ids == ["G2", "G3"] and got[PRINT, 3].guard_ids == ["G4", "G5"]
    assert cards.numbering_errors(cards.rules(facts)).count() == 0
    used = cards.rules(facts).select("entry_id", F.explode("guard_ids").alias("guard_id"))
    errors = {(r.entry_id, r.guard_id, r.error) for r in cards.coverage_errors(facts, used, used.where("guard_id = 'G3'")).collect()}
    assert errors == {(REGISTER, "G1", "missing"), (PRINT, "G3", "duplicate")}


def test_cards(facts, spark):
    u = {r.page_id: r for r in cards.use_cases(facts).collect()}
    assert u[PRINT].effects == ["Creates Label.", "Changes Parcel: `Status` → `Sent`.", "Sends `CallCourier`."]
    assert u[REGISTER].effects == ["Creates Parcel.", "Publishes `ParcelRegistered`.", ] and u[REGISTER].triggers == ["POST /parcels"]
    assert {(d.op, d.table, d.columns) for d in u[PRINT].data} == {("read", "customers", "email"), ("insert", "Label", ""), ("update", "parcels", "status")}
    e = {r.name: r for r in cards.entities(facts).collect()}
    assert {s.state: s.is_final for s in e["Parcel"].statuses} == {"Registered": False, "Sent": False, "Delivered": True, "Failed": True}
    assert ("Sent", PRINT) in {(p.to_state, p.entry_id) for p in e["Parcel"].performers} and "Customer" not in e
    assert {r.behavior: r.entry_id for r in cards.behavior_applies(facts).collect()} == {"T:Ship.ValidationBehavior": REGISTER}
    m = {r.module: r.depends_on for r in cards.modules(facts).collect()}
    assert m["Print"] == ["Ship"] and m["Ship"] == ["Ship.Api"]
    manual = spark.createDataFrame([("Paczka", "parcel", "box")], "term string, code_name string, meaning string")
    assert [(r.term, r.manual) for r in cards.glossary(facts, manual).collect()] == [("Customer", False), ("Label", False), ("Paczka", True)]


def test_pages_and_links(facts, spark):
    notes = spark.createDataFrame([("use-cases/Print-label.md", "mind the gap")], "path string, notes string")
    pages = render.use_case_pages(cards.use_cases(facts), "c0ffee", notes).unionByName(render.entity_pages(cards.entities(facts), "c0ffee", notes))
    done = render.resolve_links(pages, "https://git/{commit}/{path}#L{line}", "c0ffee")
    by = {r.page_id: r for r in done.collect()}
    text = by["T:Ship.ParcelRegisteredEventHandler"].content
    assert "- Starts [Print label](Print-label.md)." in text and text.startswith('---\ntitle: "Parcel registered"\n')
    assert by[PRINT].content.endswith("## Notes\n\nmind the gap\n")
    assert "    Registered --> Sent\n" in by["entity:Parcel"].content
    assert render.duplicate_warnings(pages).count() == 0
    again = render.resolve_links(pages, "https://git/{commit}/{path}#L{line}", "c0ffee")
    assert {r.page_id: r.hash for r in again.collect()} == {k: r.hash for k, r in by.items()}
    stored = {r.page_id: r.storage for r in render.storage(done).collect()}
    assert '<ri:page ri:content-title="Print label" />' in stored["T:Ship.ParcelRegisteredEventHandler"]
    asked = spark.createDataFrame([(PRINT,), ("nobody",)], "page_id string")
    assert {r.page_id: r.content[:12] for r in render.page_or_card(asked, done, cards.use_cases(facts)).collect()}["nobody"] == "Unknown page"
    texts = spark.createDataFrame([("p", f"[[page:{PRINT}]] [[page:x]] [[code:src/Print.cs:12|l]] [[code:src/Print.cs:99]]")], "page_id string, text string")
    assert sorted(r.error for r in cards.link_errors(texts, done, facts.chunks).collect()) == ["no code at code:src/Print.cs:99", "unknown page page:x"]


def test_all_kinds_of_pages(facts, spark):
    notes = spark.createDataFrame([("index.md", "read me")], "path string, notes string")
    use_cases, entities, steps = cards.use_cases(facts), cards.entities(facts), flows.discover(facts)
    titles, homes = use_cases.select(F.col("page_id").alias("entry_id"), "title"), facts.entries.select("entry_id", "module")
    stops = flows.silent_stops(steps, facts.guards, facts.edges, cards.rules(facts), facts.transitions)
    pages = render.use_case_pages(use_cases, "c0ffee", notes).unionByName(render.entity_pages(entities, "c0ffee", notes))
    pages = pages.unionByName(render.flow_pages(steps, flows.diagram(steps, facts.guards, titles), stops, titles, homes, "c0ffee", notes))
    pages = pages.unionByName(render.global_rule_pages(facts.entries, facts.guards, cards.behavior_applies(facts), "c0ffee", notes))
    pages = pages.unionByName(render.module_pages(cards.modules(facts), use_cases, entities, render.flow_modules(steps, homes), "c0ffee", notes))
    pages = pages.unionByName(render.glossary_page(cards.glossary(facts, spark.createDataFrame([("Paczka", "parcel", "box")], "term string, code_name string, meaning string")), "c0ffee", notes))
    pages = pages.unionByName(render.system_page(pages, "c0ffee", notes))
    got = {r.page_id: r for r in render.resolve_links(pages, "https://git/{commit}/{path}#L{line}", "c0ffee").collect()}
    assert {r.kind for r in got.values()} == {"use_case", "entity", "flow", "global_rule", "module", "glossary", "system"}
    assert all(r.parent_page_id in got for r in got.values() if r.kind != "system") and got["system"].parent_page_id is None
    flow = got["flow:POST /parcels"].content
    assert '    C{"parcel.Kind == ParcelKind.Letter?"}\n' in flow and '    C -- "yes" --> D\n' in flow and "| 1 | [Register parcel](../use-cases/Register-parcel.md) | Ship |  |" in flow
    assert "| 4 | T:Ext.CallCourier | Print |  |" in flow and "| step 5 | `Parcel.Status = Failed` is final; nothing resumes the process. |" in flow and "| step 2, rule 1 |" in flow
    rule = got["T:Ship.ValidationBehavior"].content
    assert "- [Register parcel](../use-cases/Register-parcel.md)" in rule and "[Behavior.cs:1](https://git/c0ffee/src/Behavior.cs#L1)" in rule
    assert "- [Module Ship](Ship.md)" in got["module:Print"].content and "- [Process: Register parcel](../flows/POST-parcels.md)" in got["module:Print"].content
    assert "| Paczka | `parcel` | box |" in got["glossary"].content and "[[" not in "".join(r.content for r in got.values())
    assert "- [Module Ship.Api](modules/Ship.Api.md)" in got["system"].content and "- [Glossary](glossary.md)" in got["system"].content and got["system"].content.endswith("## Notes\n\nread me\n")


def test_storage_markup():
    got = render.to_storage('# A & b\n\n> note\n\n- **x** `y<`\n- [z](https://e/?a="b")\n\n| h | i |\n|---|---|\n| a\\|b | *c* |\n\n```\n]]>\n```\ntext\nmore\n')
    assert "<h1>A &amp; b</h1>" in got and "<li><strong>x</strong> <code>y&lt;</code></li>" in got
    lists = render.to_storage("1. one\n   more\n   - sub `x`\n     1. deep\n   - sub2\n2. two\n- other\n\n![a b](img/p.png) ![u](https://e/i.png)\n")
    assert "<ol><li>one more<ul><li>sub <code>x</code><ol><li>deep</li></ol></li><li>sub2</li></ul></li><li>two</li></ol><ul><li>other</li></ul>" in lists
    assert '<ac:image ac:alt="a b"><ri:attachment ri:filename="p.png" /></ac:image>' in lists and '<ri:url ri:value="https://e/i.png" />' in lists
    assert render.plain_text("a [b *c*](d.md) `e` **f**") == "a b c e f"
    assert "<td>a|b</td><td><em>c</em></td>" in got and "]]]]><![CDATA[>" in got and "<p>text more</p>" in got


CASES = {
    "no-email": {"tables": {"parcels": [{"id": 1, "weight_g": 1500.0, "status": "Registered", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": None, "is_blocked": False}], "Label": []}, "config": {"labels": True}},
    "blocked": {"tables": {"parcels": [{"id": 1, "weight_g": 1, "status": "Registered", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": "a@b", "is_blocked": True}], "Label": []}, "config": {"Labels": "true"}},
    "flag-off": {"tables": {"parcels": [{"id": 1, "weight_g": 1, "status": "Registered", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": "a@b", "is_blocked": False}], "Label": []}, "config": {"Labels": False}},
    "no-config": {"tables": {"parcels": [{"id": 1, "weight_g": 1, "status": "Registered", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": "a@b", "is_blocked": False}], "Label": []}},
    "failed": {"tables": {"parcels": [{"id": 1, "weight_g": 1, "status": "Failed", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": "a@b", "is_blocked": False}], "Label": [{"id": 1}]}, "config": {"Labels": True}},
    "no-customers": {"parcels": [{"id": 1, "weight_g": 1, "status": "Registered", "Kind": "Box"}, "dropped"], "Label": [], "note": "no table"},
    "empty": {"tables": {}},
}


@pytest.fixture(scope="module")
def shots(spark):
    return snapshots.parse(spark.createDataFrame([(k, json.dumps(v)) for k, v in CASES.items()], "case_id string, json string"))


def test_snapshot(shots):
    assert {(r.case_id, r.table) for r in shots.tables.where("case_id = 'no-customers'").collect()} == {("no-customers", "parcels"), ("no-customers", "Label")}
    assert shots.rows.where("case_id = 'no-customers'").count() == 1
    row = shots.rows.where("case_id = 'no-email' AND table = 'parcels'").first().row
    assert row["weight_g"] == "1500.0"
    assert shots.rows.where("case_id = 'no-email' AND table = 'customers'").first().row == {"customer_id": "7", "email": None, "is_blocked": "false"}


def _rule_states(facts, shots):
    own = cards.rules(facts).withColumn("rule_id", F.concat_ws("#", "entry_id", "no"))
    gid = lambda: F.concat_ws("#", "entry_id", "guard_id")
    named = own.select("rule_id", "entry_id", F.explode("guard_ids").alias("guard_id")).join(facts.guards, ["entry_id", "guard_id"]).withColumn("guard_id", gid())
    out = rules.evaluate(named, facts.entities, facts.fields, shots.cases, shots.tables, shots.rows, shots.config)
    return out.join(own.select("rule_id", "entry_id"), "rule_id")


def test_rules(facts, shots):
    got = {(r.case_id, r.rule_id): r for r in _rule_states(facts, shots).collect()}
    state = lambda case, n, entry=PRINT: got[case, f"{entry}#{n}"].state
    assert [state("no-email", n) for n in (1, 2, 3)] == ["ok", "ok", "violated"]
    assert [state("blocked", n) for n in (1, 2, 3)] == ["ok", "violated", "ok"]
    assert [state("flag-off", n) for n in (1, 2, 3)] == ["violated", "ok", "ok"] and got["flag-off", f"{PRINT}#1"].silent
    assert state("no-config", 1) == "unknown" and got["no-config", f"{PRINT}#1"].evidence == ["no value for flag Labels"]
    assert state("no-customers", 3) == "unknown" and "table not fetched: Customer" in got["no-customers", f"{PRINT}#3"].evidence
    assert state("no-email", 1, REGISTER) == "ok"


def test_diagnosis(facts, shots, spark):
    placed = rules.entity_tables(facts.entities, shots.cases, shots.tables)
    row_facts = shots.rows.withColumnRenamed("table", "snap_table").join(placed, ["case_id", "snap_table"]).select("case_id", "entity", "row")
    states = facts.transitions.select("entity", "field").distinct()
    values = row_facts.select("case_id", "entity", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")).unionByName(
        row_facts.join(states, "entity").select("case_id", "entity", "field", joins.map_value(F.col("row"), [F.lower("field")]).alias("value"))
    )
    steps = flows.discover(facts)
    state = diagnose.steps(steps, facts.entries, shots.cases, diagnose.effects(facts.edges, facts.transitions, placed, values))
    by = {(r.case_id, r.no): r.state for r in state.collect()}
    assert [by["no-email", n] for n in range(1, 6)] == ["done", "no_trace", "not_done", "external", "not_done"]
    assert [by["failed", n] for n in (1, 3, 5)] == ["done", "done", "done"] and by["empty", 1] == "unknown"
    negative = values.where("value = 'Failed'").select("case_id", F.lit("Failed").alias("outcome")).distinct()
    outcome = state.join(negative, "case_id", "left").withColumn("outcome", F.when(F.col("no") == 5, F.col("outcome")))
    found = {r.case_id: r for r in diagnose.analyze(shots.cases, diagnose.flow_checks(outcome), state, _rule_states(facts, shots)).collect()}
    assert {k: r.verdict for k, r in found.items()} == {"no-email": "cause_found", "blocked": "cause_found", "flag-off": "cause_found", "no-config": "candidates", "failed": "outside_code", "no-customers": "candidates", "empty": "insufficient_data"}
    assert found["no-email"].break_no == 3 and found["no-email"].causes == [f"{PRINT}#3"]
    assert "no value for flag Labels" in found["no-config"].missing


def test_negative_outcomes(facts, shots, spark):
    placed = rules.entity_tables(facts.entities, shots.cases, shots.tables)
    row_facts = shots.rows.withColumnRenamed("table", "snap_table").join(placed, ["case_id", "snap_table"]).select("case_id", "entity", "pos", "row")
    none = F.lit(None).cast("string")
    status = joins.map_value(F.col("row"), [F.lower("field")])
    values = row_facts.withColumns({"field": none, "value": none}).unionByName(row_facts.join(facts.transitions.select("entity", "field").distinct(), "entity").withColumn("value", status))
    negative = diagnose.outcomes(facts.edges, facts.transitions, values)
    state = diagnose.steps(flows.discover(facts), facts.entries, shots.cases, diagnose.effects(facts.edges, facts.transitions, placed, values), negative)
    shown = "Parcel.Status = Failed (id = 1, weight_g = 1, status = Failed, Kind = Box)"
    assert [(r.case_id, r.no, r.outcome) for r in state.where("outcome IS NOT NULL").collect()] == [("failed", 5, shown)]
    found = {r.case_id: r for r in diagnose.analyze(shots.cases, diagnose.flow_checks(state), state, _rule_states(facts, shots)).collect()}
    assert {k: r.verdict for k, r in found.items()} == {"no-email": "cause_found", "blocked": "cause_found", "flag-off": "cause_found", "no-config": "candidates", "failed": "outside_code", "no-customers": "candidates", "empty": "insufficient_data"}
    assert found["failed"].negative == shown and found["no-email"].negative is None
    held = [("c", "Parcel", "Status", v, i, {"n": str(i), "x": None}) for i, v in enumerate(["Sent", None, "FAILED", "Failed"])]
    held = spark.createDataFrame(held, "case_id string, entity string, field string, value string, pos int, row map<string,string>")
    assert [r.outcome for r in diagnose.outcomes(facts.edges, facts.transitions, held).collect()] == ["Parcel.Status = Failed (n = 2)"]


def test_pages_on_disk(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a b.md").write_text("# A\n")
    (root / "sub" / "a b.notes.md").write_bytes(b"\r\n note \r\n")
    (root / "c.md").write_text("# C\n")
    (root / "c.notes.md").write_text(" \n")
    files = page_source.read_pages(spark, str(root))
    got = {r.path: r.notes for r in page_source.with_notes(files, files).collect()}
    assert got == {"sub/a b.md": "note", "c.md": None}
    new = files.select("path", F.col("markdown").alias("content"), F.sha2("markdown", 256).alias("hash"))
    first = page_source.write_changed(new.limit(0), new, str(tmp_path / "out"))
    assert {r.action for r in first.collect()} == {"create"}
    assert {r.action for r in page_source.write_changed(new, new, str(tmp_path / "out")).collect()} == {"unchanged"}


def test_jobs(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "card_hash string, prompt string")
    cache = spark.createDataFrame([("a", "cached", "ok")], "card_hash string, answer string, status string")

    def complete(prompt, attempt, errors):
        if prompt == "p4":
            raise OSError("down")
        return (f"{prompt}@{attempt}", None if prompt == "p2" and errors == ["bad"] else "bad")

    jobs = jobs.unionByName(spark.createDataFrame([("d", "p4")], jobs.schema))
    made = cards.run_jobs(jobs, cache, complete)
    got = {r.card_hash: (r.answer, r.status) for r in made.collect()}
    assert got == {"a": ("cached", "ok"), "b": ("p2@1", "ok"), "c": ("p3@2", "needs_review"), "d": (None, "offline")}
    folder = str(tmp_path / "cache")
    cards.cache_answers(made, cards.read_cache(spark, folder), folder)
    assert {r.card_hash for r in cards.read_cache(spark, folder).collect()} == {"a", "b", "c"}


def test_asof_forward_takes_one_pass_of_a_key(spark):
    """A million rows of one key; ties at the same place take the smallest value."""
    n = 500_000
    left = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 2).alias("at"))
    right = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 2 + F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("at"), F.col("id").alias("v"))
    got = joins.asof_forward(left, right, "key", "at", "v")
    assert got.agg(F.count_if(F.col("next_at").isNotNull()), F.count_if(F.col("next_value") == F.col("at") / 2)).first() == (n, n)
    few = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "key string, at int")
    ties = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("a", 4, 1)], "key string, at int, v int")
    assert {(r.key, r.at, r.next_at, r.next_value) for r in joins.asof_forward(few, ties, "key", "at", "v").collect()} == {("a", 1, 1, 3), ("a", 5, None, None), ("b", 1, None, None)}


def test_range_lookup_of_any_length(spark):
    """Random spans against all pairs; one span of a thousand million numbers among many short ones of the same key."""
    import random

    r = random.Random(2)
    spans = [(i, r.choice("ab"), x := r.randint(-50, 200), x + r.choice([-1, 0, 1, 7, 63, 64, 300])) for i in range(60)]
    points = [(i, r.choice("abc"), r.randint(-60, 300)) for i in range(200)]
    got = joins.range_lookup(spark.createDataFrame(points, "p bigint, k string, at int"), spark.createDataFrame(spans, "s int, k string, low int, high int"), "p", "k", "at", "low", "high", "s", ["s"])
    want = {p: min((s for s, k2, a, b in spans if k == k2 and a <= at <= b), default=None) for p, k, at in points}
    assert {x.p: x.s for x in got.collect()} == want
    n = 100_000
    short = spark.range(n).select(F.col("id").alias("s"), F.lit("k").alias("k"), (F.col("id") * 100).alias("low"), (F.col("id") * 100 + 49).alias("high"))
    long_ = spark.createDataFrame([(n + 1, "k", -500_000_000, 500_000_000)], short.schema)
    asked = spark.range(n).select(F.col("id").alias("p"), F.lit("k").alias("k"), (F.col("id") * 100 + F.when(F.col("id") % 2 == 0, 10).otherwise(60)).alias("at"))
    got = joins.range_lookup(asked, short.unionByName(long_), "p", "k", "at", "low", "high", "s", ["s"])
    assert got.agg(F.count_if(F.col("s") == F.col("p")), F.count_if(F.col("s") == n + 1)).first() == (n // 2, n // 2)
    none = joins.range_lookup(asked.limit(3), short.limit(0), "p", "k", "at", "low", "high", "s", ["s"])
    assert [x.s for x in none.collect()] == [None] * 3
    with pytest.raises(TypeError):
        joins.range_lookup(asked.withColumn("at", F.lit(1.5)), short, "p", "k", "at", "low", "high", "s", ["s"])


def test_range_lookup_broadcasts_no_stretches(spark):
    """A table of stretches is much larger than Spark's estimate of it, however small the spans' file is."""
    spans = spark.range(1000).select(F.col("id").alias("s"), (F.col("id") % 7).alias("k"), F.col("id").alias("low"), (F.col("id") + 5000 - F.col("id") % 3).alias("high"))
    points = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 7).alias("k"), (F.col("id") * 7 - 300).alias("at"))
    got = joins.range_lookup(points, spans, "p", "k", "at", "low", "high", "s", ["s"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("BroadcastHashJoin")[1:] if "_number" in x.split("\n")[0]] and "SortMergeJoin" in plan
    want = {p: min((s for s in range(1000) if s % 7 == p % 7 and s <= p * 7 - 300 <= s + 5000 - s % 3), default=None) for p in range(1000)}
    assert {x.p: x.s for x in got.collect()} == want
    most = (1 << 63) - 1  # a span whose length is no bigint
    wide = spark.createDataFrame([(1, 0, -most, most - 1)], "s bigint, k bigint, low bigint, high bigint")
    assert joins.range_lookup(points, wide, "p", "k", "at", "low", "high", "s", ["s"]).agg(F.count("s")).first()[0] == 143


@pytest.mark.parametrize("parse", [False, True])
def test_rows_meet_guards_in_one_partition_of_their_case(spark, parse):
    """Rows are dealt once, by case, and guards are sent to them (before: a row of each case, guard and row was joined and grouped over shuffles)."""
    columns = "rule_id string, pos int, guard_id string, kind string, condition string, exit string, left_side string, op string, right_side string"
    if parse:
        made = [("R", 0, "G", "if", "order.Total > 5 || bill.State == S.Open", "return", None, None, None)]
    else:
        made = [("R", 0, "G", "if", "x.Total > 5", "return", "x.Total", ">", "5"), ("F", 0, "H", "filter", "Where(o => o.Total > 5 && o.State == S.Open)", "filter", None, None, None)]
    guards = spark.createDataFrame(made, columns)
    entities = spark.createDataFrame([("Order", "orders"), ("Bill", None)], "entity string, table string")
    fields = spark.createDataFrame([(e, n, n.lower()) for e in ("Order", "Bill") for n in ("Total", "State")], "entity string, name string, column string")
    held = {("a", "ORDERS"): [("9", "open"), ("7", "shut")], ("b", "bills"): [("3", "Open")], ("c", "orders"): [("9", "x")], ("c", "Bill"): [("1", "Open")], ("d", "other"): [("9", "Open")]}
    rows = spark.createDataFrame([(c, t, i, {"TOTAL": x, "State": y}) for (c, t), each in held.items() for i, (x, y) in enumerate(each)], "case_id string, table string, pos int, row map<string,string>")
    cases, none = spark.createDataFrame([(c,) for c in "abcde"], "case_id string"), spark.createDataFrame([], "case_id string, key string, value string")
    found = rules.evaluate(guards, entities, fields, cases, rows.select("case_id", "table").distinct(), rows, none, parse)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [case_id" in plan and "Window" not in plan
    got = {(r.case_id, r.rule_id): (r.state, r.evidence, r.missing) for r in found.collect()}
    if parse:
        assert {k: v[0] for k, v in got.items()} == {("a", "R"): "violated", ("b", "R"): "violated", ("c", "R"): "violated", ("d", "R"): "unknown", ("e", "R"): "unknown"}
        assert got["a", "R"][1:] == (["ORDERS.Total = 9, 7; table not fetched: Bill"], ["ORDERS.Total = 9, 7; table not fetched: Bill"])
    else:
        assert {k: v[0] for k, v in got.items() if k[1] == "R"} == {("a", "R"): "violated", ("b", "R"): "ok", ("c", "R"): "unknown", ("d", "R"): "unknown", ("e", "R"): "unknown"}
        assert got["a", "F"] == ("ok", ["ORDERS: 1 of 2 rows match"], []) and got["b", "F"] == ("violated", ["bills: 0 of 1 rows match"], []) and got["c", "F"][0] == "unknown"


@pytest.mark.parametrize("parse", [False, True])
def test_a_case_is_dealt_once_for_all_kinds_of_guards(spark, parse):
    """One exchange of cases, rows and settings (before: one for each join of cases and guards); a fetched table without rows says so (before: nothing)."""
    columns = "rule_id string, pos int, guard_id string, kind string, condition string, exit string, left_side string, op string, right_side string"
    made = [
        ("F", 0, "F1", "filter", "Where(o => o.Total > 5 && o.State == S.Open)", "filter", None, None, None),
        ("F", 1, "F2", "if", "!orders.Any()", "return", None, None, None),
        ("G", 0, "G1", "if", "order.Total > 5", "fail:X", "Order.Total", ">", "5"),
        ("G", 1, "G2", "if", "RuleFor(x)", "validation", None, None, None),
        ("X", 0, "X1", "if", '!f.IsEnabledAsync("Pay")', "fail:X", None, None, None),
    ]
    entities = spark.createDataFrame([("Order", "orders")], "entity string, table string")
    fields = spark.createDataFrame([("Order", n, n.lower()) for n in ("Total", "State")], "entity string, name string, column string")
    rows = spark.createDataFrame([("a", "Orders", i, {"TOTAL": x, "State": y}) for i, (x, y) in enumerate([("9", "open"), ("7", "shut"), ("9", "Open")])], "case_id string, table string, pos int, row map<string,string>")
    tables = spark.createDataFrame([("a", "Orders"), ("b", "ORDERS")], "case_id string, table string")
    config = spark.createDataFrame([("a", "PAY", "false"), ("b", "pay", "true")], "case_id string, key string, value string")
    cases = spark.createDataFrame([(c,) for c in "abc"], "case_id string")
    both = [rules.evaluate(spark.createDataFrame(made, columns), entities, fields, cases, t, rows, config, parse) for t in (tables, None)]
    for found in both:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(case_id") == 1 and "SortMergeJoin" not in plan
    got, own = [{(r.case_id, r.rule_id): (r.state, r.evidence, r.missing) for r in found.collect()} for found in both]
    assert got["a", "F"] == ("ok", ["Orders: 2 of 3 rows match"], []) and got["b", "F"] == ("violated", ["ORDERS: 0 of 0 rows match"], []) and own["b", "F"] == ("unknown", ["table not fetched: Order"], ["table not fetched: Order"])
    assert got["a", "G"] == ("violated", ["Orders.Total = 9, 7", "input data, not in the database: RuleFor(x)"], []) and got["b", "G"][1][0] == "no row in ORDERS" and got["c", "G"][2] == ["table not fetched: Order"]
    assert [got[c, "X"] for c in "abc"] == [("violated", ["flag Pay = false"], []), ("ok", ["flag Pay = true"], []), ("unknown", ["no value for flag Pay"], ["no value for flag Pay"])]
    assert {k: v for k, v in got.items() if k[0] == "a"} == {k: v for k, v in own.items() if k[0] == "a"}
