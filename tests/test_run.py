"""Commands, tools, sinks, expected facts, settings and type facts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import cards, flows, run, tools
from ledgerloom.sources import expected, settings, sinks, snapshots, types
from ledgerloom.sources import facts as fact_source

DATA = Path(__file__).parent / "data"
PRINT, REGISTER = "T:Ship.PrintLabelCommandHandler", "T:Ship.RegisterParcelCommandHandler"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("work"))
    facts, counts = run.index(spark, str(DATA / "facts.json"))
    assert counts == {"entries": 8, "entities": 3}
    manual = spark.createDataFrame([("Paczka", "parcel", "box")], "term string, code_name string, meaning string")
    made = run.make_cards(facts, manual, folder)
    pages = run.pages_of(facts, made, "c0ffee", run.page_notes(spark, f"{folder}/pages"))
    return facts, made, pages, folder


def test_render_and_stale_files(spark, work):
    facts, made, pages, folder = work
    root = f"{folder}/pages"
    n = pages.count()
    assert run.write_pages(pages, root) == {"pages": n, "written": n, "deleted": 0}
    assert run.write_pages(pages, root) == {"pages": n, "written": 0, "deleted": 0}
    Path(root, "kept.txt").write_text("not ours")
    fewer = pages.where("kind <> 'entity'")
    assert run.write_pages(fewer, root)["deleted"] == pages.where("kind = 'entity'").count()
    assert not list(Path(root, "entities").glob("*.md")) and Path(root, "kept.txt").exists()
    manifest = json.loads(Path(root, "manifest.json").read_text())
    assert {p["pageId"] for p in manifest["pages"]} == {r.page_id for r in fewer.collect()}
    assert {r.page_id for r in made["catalogue"].collect()} == {r.page_id for r in pages.collect()}
    Path(root, "glossary.notes.md").write_text("see also\r\n")
    again = run.pages_of(facts, made, "c0ffee", run.page_notes(spark, root))
    assert again.where("page_id = 'glossary'").first().content.endswith("## Notes\n\nsee also\n")


def test_index_and_ask(spark, work):
    facts, made, pages, folder = work
    path = f"{folder}/points"
    n = run.search_index(pages, path)
    assert n > 10 and run.search_index(pages, path) == 0
    changed = pages.withColumn("content", F.when(F.col("page_id") == PRINT, F.concat("content", F.lit("\n## More\n\nzebra crossing\n"))).otherwise(F.col("content"))).withColumn("hash", F.sha2("content", 256))
    assert 0 < run.search_index(changed, path) < n
    points = run.read_points(spark, path)
    assert run.ask(points, "zebra crossing").startswith("1. Print label › More: zebra crossing")
    assert run.search_index(changed.where(F.col("page_id") != PRINT), path) == 0
    assert run.read_points(spark, path).where(F.col("page_id") == PRINT).count() == 0
    assert run.ask(points, "qqqq").startswith(("1. ", "Nothing found."))  # dense cells may still share a hash


def test_agent_report(spark, work):
    facts, made, pages, folder = work
    case = {"tables": {"parcels": [{"id": 1, "weight_g": 1500.0, "status": "Registered", "Kind": "Box"}], "customers": [{"customer_id": 7, "email": None, "is_blocked": False}], "Label": []}, "config": {"labels": True}}
    shots = snapshots.parse(spark.createDataFrame([("c", json.dumps(case))], "case_id string, json string"))
    asked = []

    def model(messages, functions, may_call):
        asked.append(may_call)
        if len(asked) == 1:
            return {"tool_calls": [{"id": "1", "name": "get_rows", "arguments": '{"table": "PARCELS"}'}, {"id": "2", "name": "find_usages", "arguments": '{"name": "Parcel.Status"}'}]}
        return {"content": f"Seen {len(messages)} messages, {len(functions)} tools."}

    said = run.agent(facts, made, pages, None, "why is there no label for the parcel", shots, "c", model)
    assert "Seen 4 messages, 9 tools." in said and '- get_rows: `{"table": "PARCELS"}`' in said
    assert "A broken rule explains the stop. Process: `flow:" in said and "Print label: **ends here**" in said and "- broken: **Print label, 3** if `" in said and "## Read" in said
    assert "  - seen: " in said and "  - code: Print.cs:" in said and "1. Register parcel: seen (Parcel: 1 rows)" in said
    linked = run.agent(facts, made, pages, None, "label", shots, "c", None, "https://git/{commit}/{path}#L{line}", "c0ffee")
    assert "](https://git/c0ffee/src/Print.cs#L" in linked and linked.startswith("# label\n\nFound without a language model:\n\n## Finding")
    plain = run.agent(facts, made, pages, None, "label", None, None, None)
    assert "Found without a language model" in plain and "## Finding" not in plain
    calls = tools.converse(lambda m, t, may: {"content": None, "tool_calls": [{"id": "1", "name": "x", "arguments": ""}]}, "q", lambda n, a: "", [], 3)
    assert calls == (None, [("x", "")] * 2)


def test_tools(spark, work):
    facts, made, pages, folder = work
    names = spark.createDataFrame([("Parcel.Status",), ("parcel",), ("Nothing",)], "name string")
    found = tools.find_usages(names, facts)
    got = {r.name: r.answer for r in tools.usages_text(found, names, made["use_cases"].select(F.col("page_id").alias("entry_id"), "title")).collect()}
    assert f"{PRINT} (Print label)\n   writes Parcel.Status [" in got["Parcel.Status"] and "entity Parcel: table parcels, transitions: ∅ → Registered" in got["Parcel.Status"]
    assert got["Nothing"] == "No usages of Nothing found." and "insert" in got["parcel"]
    asked = spark.createDataFrame([("src/Print.cs:12",), ("src/Print.cs:9999",), ("nowhere",)], "location string")
    code = {r.location: r.answer for r in tools.code_text(asked, facts.chunks).collect()}
    assert code["nowhere"] == "Give a place as path:line." and code["src/Print.cs:9999"].startswith("No code") and code["src/Print.cs:12"][:7].strip().isdigit()
    ids = spark.createDataFrame([(PRINT,), ("x",)], "page_id string")
    rules = {r.page_id: r.answer for r in tools.rules_text(ids, made["rules"], facts.guards).collect()}
    assert rules["x"] == "No use case x." and "\n2. " in rules[PRINT] and "   G2: `" in rules[PRINT]
    shots = snapshots.parse(spark.createDataFrame([("c", '{"tables": {"Parcels": [{"id": 1}], "none": []}}')], "case_id string, json string"))
    rows = {r.table: r.answer for r in tools.rows_text(spark.createDataFrame([("c", "parcels"), ("c", "x"), ("c", "NONE")], "case_id string, table string"), shots.tables, shots.rows).collect()}
    assert rows == {"parcels": '[{"id":"1"}]', "x": "Table x was not fetched. There are: Parcels, none.", "NONE": "[]"}
    lib = tools.Library(facts, pages, made["use_cases"], made["rules"], made["use_cases"].select(F.col("page_id").alias("entry_id"), "title"), tools.documents(made["use_cases"], made["entities"], made["steps"], flows.silent_stops(made["steps"], facts.guards, facts.edges), made["global_rules"], made["glossary"]))
    assert tools.answer(lib, "nope", "{}") == "Unknown tool: nope" and tools.answer(lib, "get_page", "{").startswith("Wrong arguments")
    assert "(page_id: " in tools.answer(lib, "search_docs", '{"query": "print label"}') and tools.answer(lib, "get_rows", '{"table": "x"}') == "There is no case data."
    assert "glossary | glossary | Glossary" in tools.answer(lib, "list_pages", "") and tools.answer(lib, "get_page", '{"page_id": "glossary"}').startswith("---")
    assert len(tools.definitions(False)) == 6 and len(tools.definitions(True)) == 9
    assert {r.section for r in lib.docs.collect()} >= {"Description", "Business rules", "Entity", "Process", "Global rule"}


def test_rerank_and_embeddings(spark):
    shapes = spark.createDataFrame([("a", '{"results": [{"index": 1, "relevance_score": 0.5}, {"index": 0, "relevance_score": 0.9}]}'), ("b", ' [{"index": 2, "score": 0.1}]')], "query string, json string")
    assert sorted(map(tuple, tools.rerank_scores(shapes).collect())) == [("a", 0, 0.9), ("a", 1, 0.5), ("b", 2, 0.1)]
    assert tools.parse_embeddings('{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}') == [[1], [2]]
    texts = spark.createDataFrame([(i, "x" * i) for i in range(150)], "id bigint, body string").coalesce(1)

    def embed(batch):
        assert len(batch) <= 64
        return [[len(t), 1.0] for t in batch]

    assert {r.id: r.vector[0] for r in tools.embed_in_batches(texts, "id", "body", embed, 2).collect()} == {i: float(i) for i in range(150)}
    with pytest.raises(Exception, match="expected"):
        tools.embed_in_batches(texts, "id", "body", embed, 3).collect()


def test_expected(spark, work, tmp_path):
    facts = work[0]
    own = expected.actual(facts)
    of = lambda i, prefix="": sorted(r.line for r in own.where(F.col("id") == i).collect() if r.line and r.line.startswith(prefix))
    entity = facts.entities.where("entity = 'Parcel'").first().entity_id
    moves = [x.removeprefix("transition ") for x in of(entity, "transition ")]
    document = {"Entries": {PRINT: {"guards": of(PRINT), "EDGES": ["writes Nothing"]}, "T:Gone": {"guards": [], "edges": []}}, "entities": {entity: {"table": "parcels", "transitions": moves[1:]}}}
    (tmp_path / "e.json").write_text(json.dumps(document))
    code, found = run.check_index(facts, str(tmp_path / "e.json"))
    assert code == 1
    assert sorted((r.id, r.line, r.side) for r in found.collect()) == sorted([(PRINT, "writes Nothing", "missing"), ("T:Gone", "", "not found"), (entity, f"transition {moves[0]}", "extra")])
    document = {"entries": {}, "entities": {entity: {"table": "parcels", "transitions": moves, "columns": ["Nope x"]}}}
    (tmp_path / "f.json").write_text(json.dumps(document))
    code, found = run.check_index(facts, str(tmp_path / "f.json"))
    assert code == 1 and {r.side for r in found.collect()} == {"missing", "extra"} and all(r.line.startswith("column ") for r in found.collect())


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"A": {"B": 1, "C": [true, null]}, "work": "x"}')
    assert settings.load(str(tmp_path / "s.json"), {"LEDGERLOOM_A__B": "2", "OTHER": "3"}) == {"a.b": "2", "a.c.0": "true", "work": "x"}
    assert settings.load(str(tmp_path / "none.json"), {}) == {} and settings.commit_of("/nonexistent") == "unknown"
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    assert settings.commit_of(str(tmp_path)) == "unknown"
    (tmp_path / ".git/refs/heads/main").write_text("abc\n")
    assert settings.commit_of(str(tmp_path / "sub")) == "abc"


def test_sinks(spark, tmp_path):
    pauses, tries = [], []

    def call(answers):
        tries.append(1)
        if answers:
            raise answers.pop(0)
        return "ok"

    assert sinks.with_retry(call, [sinks.Refused(429, 7), sinks.Refused(503), sinks.Refused(500, 900)], sleep=pauses.append) == "ok"
    assert pauses == [7, 4.0, 60.0]
    with pytest.raises(sinks.Refused):
        sinks.with_retry(call, [sinks.Refused(404)], sleep=pauses.append)
    folder = str(tmp_path / "sent")

    def send(batch):
        import uuid

        Path(folder).mkdir(exist_ok=True)
        Path(folder, uuid.uuid4().hex).write_text(json.dumps([r["id"] for r in batch]))

    assert sinks.send_batches(spark.range(150).coalesce(1), 64, send) == 150
    sent = [json.loads(p.read_text()) for p in Path(folder).iterdir()]
    assert sorted(map(len, sent)) == [22, 64, 64] and sorted(i for b in sent for i in b) == list(range(150))
    assert sinks.write_json(spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string"), str(tmp_path / "d/x.json")) and json.loads((tmp_path / "d/x.json").read_text())[0] == {"i": 1, "s": "a"}
    pages = spark.createDataFrame([("a", "A", "c", "h1", None), ("b", "B", "c", "h2", "a"), ("c", "C", "c", "h3", "b")], "page_id string, title string, content string, hash string, parent_page_id string")
    remote = spark.createDataFrame([("A", "a", "h1", "v1", None, "r1", 3), ("C", "c", "old", "v1", "b", "r3", 5)], "title string, stamp_page_id string, stamp_hash string, stamp_format string, parent string, remote_id string, version int")

    class Client:
        def __init__(self):
            self.log = []

        def create(self, page, up):
            self.log.append(("create", page["page_id"], up))
            return "new"

        def update(self, page, remote_id, version, up):
            self.log.append(("update", remote_id, version, up))

    client = Client()
    assert sinks.publish(pages, remote, "v1", client) == {"create": 1, "update": 1, "unchanged": 1, "foreign": 0}
    assert client.log == [("create", "b", "r1"), ("update", "r3", 6, "new")]
    assert sinks.publish(pages, remote, "v1", None, True)["create"] == 3
    with pytest.raises(ValueError, match="A"):
        sinks.publish(pages, remote.withColumn("stamp_page_id", F.lit("other")), "v1", client)
    gone = spark.createDataFrame([("A", True), ("Z", True), ("Y", False)], "title string, labelled boolean")
    assert [r.title for r in sinks.orphans(gone, pages).collect()] == ["Z"]


def test_cards_in_code(spark, work):
    facts, made = work[0], work[1]
    code = {(r.entry_id, r.no): r for r in cards.code_rules(facts, made["rules"]).collect()}
    assert code[PRINT, 1].condition.startswith("`") and code[PRINT, 1].locations and set(code) == {(r.entry_id, r.no) for r in made["rules"].collect()}
    edges = spark.createDataFrame([("e", 0, "reads_config", "MailOptions.Host", None), ("e", 1, "reads_config", "Other.X", "d"), ("e", 2, "reads_config", "Free.Y", None), ("e", 3, "reads", "MailOptions.Host", None)], "entry_id string, pos int, type string, target string, detail string")
    options = spark.createDataFrame([("MailOptions", "Host", '"localhost"'), ("Free", "Y", None)], "type string, property string, initializer string")
    bindings = spark.createDataFrame([("MailOptions", "Mail")], "type string, section string")
    assert [(r.target, r.detail) for r in cards.config_keys(edges, options, bindings).orderBy("pos").collect()] == [("Mail:Host", 'default "localhost"'), ("Other.X", "d"), ("Free.Y", None), ("MailOptions.Host", None)]
    assert made["system"].first().n_flows == made["flows"].count() == 1 and made["flows"].first().steps[0].entry_id == REGISTER
    blank = spark.createDataFrame([("p", " ", None, "x")], "page_id string, a string, b string, c string")
    assert sorted(r.error for r in cards.required_errors(blank, "page_id", ["a", "b", "c"]).collect()) == ["a is missing", "b is missing"]
    rows = {(r.entry_id, r.source) for r in cards.trigger_rows(facts).collect()}
    assert (REGISTER, "POST /parcels") in rows
    read_keys = {(r.entry_id, r.target) for r in facts.edges.where("type = 'reads_config'").collect()}
    assert cards.config_rows(facts, spark.createDataFrame([], "key string, meaning string")).count() == len(read_keys)


def test_types(spark):
    rows = [("A.Pay", "A.Entities", "A.Shop.Api", False, False, ["MediatR.IRequestHandler`2"], []), ("A.V", "A", "Shop", False, False, [], ["FluentValidation.AbstractValidator`1"]), ("A.Base", "A.Entities", "S", False, True, ["IRequestHandler`2"], []), ("A.Order", "A.Entities", "S", False, False, [], []), ("A.Ev", "A.Entities", "S", False, False, ["INotification"], []), ("A.Bad", "A.Entities", "S", False, False, None, ["System.Exception"])]
    t = spark.createDataFrame(rows, "type_id string, namespace string, project string, is_static boolean, is_abstract boolean, interfaces array<string>, base_types array<string>")
    assert sorted(map(tuple, types.entries(t).collect())) == [("T:A.Pay", "request_handler", "A.Shop", "Api"), ("T:A.V", "validator", "Shop", "")]
    assert {r.type_id for r in t.where(types.is_entity([".Entities"])).collect()} == {"A.Pay", "A.Base", "A.Order"}
    routes = spark.createDataFrame([("post", "orders/{id}/"), ("get", None)], "verb string, route string")
    assert [r.entry_id for r in types.endpoints(routes).collect()] == ["POST /orders/{id}", "GET /"]
    calls = spark.createDataFrame([("c", "I.M"), ("c", "X.N")], "caller string, callee string")
    impl = spark.createDataFrame([("I.M", "A.M"), ("I.M", "B.M")], "method string, implementation string")
    assert sorted(r.target for r in types.implementations(calls, impl).collect()) == ["A.M", "B.M", "X.N"]
    ctor = spark.createDataFrame([("A", 0, ["x"]), ("A", 1, ["y", "z"]), ("A", 2, ["p", "q"])], "type_id string, pos int, parameters array<string>")
    assert types.dependencies(ctor).first().dependencies == ["y", "z"]
    exits = spark.createDataFrame([("throw", "A.Net.Timeout"), ("fail", "Errors.Taken"), ("return", None), ("return", "Result.Ok"), ("return", "x"), ("propagate", None), ("?", None)], "s string, a string")
    assert [r.x for r in exits.select(types.exit_of(F.col("s"), F.col("a")).alias("x")).collect()] == ["throw:Timeout", "fail:Taken", "return", "silent_success", "return_value", "propagate", None]
    uses = spark.createDataFrame([(1, "used"), (1, "http"), (2, None), (3, "logged")], "send_id int, use string")
    assert {r.send_id: r.detail for r in types.result_handling(uses).collect()} == {1: "http", 2: "ignored", 3: "logged"}
    c = spark.createDataFrame([("enum", "Paid", "Status"), ("string", "a", None), ("bool", "True", None), ("number", "1,5", None), ("other", "x", None)], "k string, v string, t string")
    assert [r.x for r in c.select(types.constant_text(F.col("k"), F.col("v"), F.col("t")).alias("x")).collect()] == ["Status.Paid", '"a"', "true", "1.5", None]
    writes = spark.createDataFrame([("m", "Status"), ("m", "Kind"), ("n", "Status")], "method string, field string")
    guards = spark.createDataFrame([("m", 0, "Amount", ">", "5", "c0", "fail:X"), ("m", 1, "Status", "!=", "S.Open", "c1", "throw:Y"), ("m", 2, "Kind", "!=", "K.A", "c2", "return")], "method string, pos int, field string, op string, right_side string, condition string, exit string")
    assert {(r.method, r.field): r.condition for r in types.first_guard(writes, guards).collect()} == {("m", "Status"): "c1", ("m", "Kind"): "c0", ("n", "Status"): None}


def test_main(spark, tmp_path, capsys):
    facts = ["--facts", str(DATA / "facts.json"), "--work", str(tmp_path)]
    assert run.main(["index", *facts]) == 0 and run.main(["run", *facts]) == 0 and run.main(["publish", "--dry-run", *facts]) == 0
    assert run.main(["ask", *facts, "print", "label"]) == 0 and run.main(["agent", *facts, "--out", str(tmp_path / "r.md"), "label"]) == 0
    said = capsys.readouterr().out
    assert "index: 8 entries, 3 entities" in said and "search-index: " in said and "1. " in said and (tmp_path / "r.md").read_text().startswith("# label")


def test_pages_outside_the_folder_are_an_error(spark, tmp_path):
    for path in ("/etc/x.md", "a/../../x.md", "", None):
        pages = spark.createDataFrame([("a.md", "fine"), (path, "not")], "path string, content string")
        with pytest.raises(ValueError, match="outside"):
            sinks.write_pages(pages, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_files_by_uri(tmp_path, monkeypatch):
    from pyarrow import fs as pafs

    from ledgerloom.sources import files

    monkeypatch.chdir(tmp_path)
    with pytest.raises(Exception, match="(?i)scheme|uri"):  # never a local folder of that name
        sinks.put("nowhere://host/folder/x.txt", "text")
    assert list(tmp_path.iterdir()) == []
    store = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    real = files.open_fs
    monkeypatch.setattr(files, "open_fs", lambda uri: (store, uri.split("://", 1)[1]) if uri.startswith("store://") else real(uri))
    assert sinks.write_if_changed("store://a/b.txt", "é") and not sinks.write_if_changed("store://a/b.txt", "é") and sinks.write_if_changed("store://a/b.txt", "f")
    assert (tmp_path / "a/b.txt").read_text() == "f" and files.names("store://a") == ["b.txt"] and files.read("store://a/none") is None
    assert files.remove("store://a/b.txt") and not files.remove("store://a/b.txt")
    assert files.names("store://none") == [] and files.names("store://", deep=True) == ["a"]
