"""The commands, from facts to answers: ``python -m ledgerloom.plans.run COMMAND --work FOLDER ...``

index         read a fact document, finish it and say what is in it
check-index   compare it with expected facts (exit code 1 if something is missing)
cards         make all card tables
render        write the pages, their manifest, and delete stale ones
publish       publish pages (here only ``--dry-run``; a client is given by a caller of ``publish``)
search-index  bring the index of page sections up to date
ask           answer a question from the index
agent         answer it with the data of a case
run           all of them up to the index

A folder that driver and executors share holds the work: ``cards/`` and ``points/`` are
Parquet tables, ``pages/`` the page files with ``manifest.json``.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars, text
from ledgerloom.operators import diagnose, graph, joins, retrieval, rules, sync
from ledgerloom.plans import cards, case_report, flows, render, tools
from ledgerloom.sources import expected, files, settings, sinks, snapshots
from ledgerloom.sources import facts as fact_source
from ledgerloom.sources import pages as page_source

SIGNATURE = "offline-hash:64"


def index(spark: SparkSession, path: str) -> tuple[fact_source.Facts, dict[str, int]]:
    """The facts of a document, and how many entries and entities it has."""
    facts = fact_source.load(spark, path)
    return facts, {"entries": facts.entries.count(), "entities": facts.entities.count()}


def check_index(facts: fact_source.Facts, path: str) -> tuple[int, DataFrame]:
    """Exit code, and the differences from the expected facts."""
    found = expected.check(facts, expected.read(facts.entries.sparkSession, path))
    return int(not found.where("side <> 'extra'").isEmpty()), found


def make_cards(facts: fact_source.Facts, manual: DataFrame, work: str) -> dict[str, DataFrame]:
    """Make all card tables and write them below the work folder."""
    spark, out = facts.entries.sparkSession, {}
    for name, df in cards.every_card(facts, manual).items():
        df.write.mode("overwrite").parquet(f"{work}/cards/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{work}/cards/{name}")
    return out


def pages_of(facts: fact_source.Facts, made: dict[str, DataFrame], commit: str, notes: DataFrame, template: str = "") -> DataFrame:
    """All pages of the cards, their links resolved."""
    titles, homes = made["use_cases"].select(F.col("page_id").alias("entry_id"), "title"), facts.entries.select("entry_id", "module")
    steps = made["steps"]
    stops = flows.silent_stops(steps, facts.guards, facts.edges, made["rules"], facts.transitions)
    out = render.use_case_pages(made["use_cases"], commit, notes).unionByName(render.entity_pages(made["entities"], commit, notes))
    out = out.unionByName(render.flow_pages(steps, flows.diagram(steps, facts.guards, titles), stops, titles, homes, commit, notes))
    out = out.unionByName(render.global_rule_pages(facts.entries, facts.guards, cards.behavior_applies(facts), commit, notes))
    out = out.unionByName(render.module_pages(made["modules"], made["use_cases"], made["entities"], render.flow_modules(steps, homes), commit, notes))
    out = graph.cut(out.unionByName(render.glossary_page(made["glossary"], commit, notes)))
    return graph.cut(render.resolve_links(out.unionByName(render.system_page(out, commit, notes)), template, commit))


def write_pages(pages: DataFrame, root: str) -> dict[str, int]:
    """Write pages that changed, delete those that are no longer, write the manifest; counts."""
    spark = pages.sparkSession
    old = fact_source.manifest(spark, f"{root}/manifest.json", optional=True)
    written = sinks.write_pages(pages, root).where("written").count()
    gone = sinks.delete_stale(old, pages, root)
    entry = F.struct(F.col("page_id").alias("pageId"), "path", "title", "kind", F.col("parent_page_id").alias("parentPageId"), "hash")
    document = render.manifest(pages).agg(F.array_sort(F.collect_list(entry)).alias("pages")).select(F.to_json(F.struct("pages")).alias("j")).first().j
    sinks.write_if_changed(f"{root}/manifest.json", document + "\n")
    return {"pages": pages.count(), "written": written, "deleted": len(gone)}


def points_of(pages: DataFrame) -> DataFrame:
    """``id, page_id, title, section, text, page_hash, embedder`` of the sections of all pages."""
    cut = retrieval.sections(pages.select("page_id", "content"), "page_id", "content")
    named = cut.join(pages.select("page_id", "title", F.col("hash").alias("page_hash")), "page_id")
    return named.select(text.point_id(F.col("page_id"), F.col("section")).alias("id"), "page_id", "title", "section", "text", "page_hash", F.lit(SIGNATURE).alias("embedder"))


def search_index(pages: DataFrame, path: str) -> int:
    """Bring the table of points up to date; the number of points written. The new state is written beside the old one and then takes its place by name."""
    spark = pages.sparkSession
    now = read_points(spark, path)
    made = points_of(pages)
    old = now if now is not None else made.limit(0)
    up, gone = sync.index_sync(old, pages.select("page_id", "hash"), made, SIGNATURE)
    up, gone = graph.cut(up), graph.cut(gone)
    n = up.count()
    if n or not gone.isEmpty() or now is None:
        newest = _newest(path) + 1
        sync.merge(old, up, gone, "id").write.mode("overwrite").parquet(f"{path}/state-{newest:06d}")
        sinks.put(f"{path}/_current", str(newest))
    return n


def _newest(path: str) -> int:
    found = files.read(f"{path}/_current")
    return int(found) if found else 0


def read_points(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of points; null before the first."""
    n = _newest(path)
    return spark.read.parquet(f"{path}/state-{n:06d}") if n else None


def ask(points: DataFrame, question: str) -> str:
    """An answer made of the best passages."""
    asked = points.sparkSession.createDataFrame([("q", question)], "query string, question string")
    hits = asked.select("query").join(tools.search(points, asked).join(points, "id"), "query", "left")
    place = F.concat("title", F.lit(" › "), "section")
    return retrieval.offline_answer(hits.withColumn("place", place), "query", "rank", "place", "text").first().answer


def analyze(facts: fact_source.Facts, made: dict[str, DataFrame], shots: snapshots.Snapshots) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of all cases: the verdicts, the states of steps, those of rules (with ``entry_id``), and the traces of entries."""
    placed = rules.entity_tables(facts.entities, shots.cases, shots.tables)
    row_facts = shots.rows.withColumnRenamed("table", "snap_table").join(placed, ["case_id", "snap_table"]).select("case_id", "entity", "pos", "row")
    none = F.lit(None).cast("string")
    columns = facts.fields.select("entity", F.col("name").alias("field"), "column")
    states = facts.transitions.select("entity", "field").distinct().join(columns, ["entity", "field"], "left")
    value = joins.map_value(F.col("row"), [F.col("column"), scalars.snake_simple(F.col("field")), F.col("field")])
    values = row_facts.withColumns({"field": none, "value": none}).unionByName(row_facts.join(states, "entity").withColumn("value", value).select("case_id", "entity", "pos", "row", "field", "value"))
    negative = diagnose.outcomes(facts.edges, facts.transitions, values)
    traces = graph.cut(diagnose.effects(facts.edges, facts.transitions, placed, values))
    steps = diagnose.steps(made["steps"], facts.entries, shots.cases, traces, negative)
    own = made["rules"].withColumn("rule_id", F.concat_ws("#", "entry_id", "no"))
    gid = F.concat_ws("#", "entry_id", "guard_id")
    guards = own.select("rule_id", "entry_id", F.explode("guard_ids").alias("guard_id")).join(facts.guards, ["entry_id", "guard_id"]).withColumn("guard_id", gid)
    found = rules.evaluate(guards, facts.entities, facts.fields, shots.cases, shots.tables, shots.rows, shots.config).join(own.select("rule_id", "entry_id"), "rule_id")
    steps, found = graph.cut(steps), graph.cut(found)
    return graph.cut(diagnose.analyze(shots.cases, diagnose.flow_checks(steps), steps, found)), steps, found, traces.where("state").select("case_id", "entry_id", "evidence")


def agent(facts: fact_source.Facts, made: dict[str, DataFrame], pages: DataFrame, points: DataFrame | None, question: str, shots: snapshots.Snapshots | None = None, case_id: str | None = None, model=None, template: str = "", commit: str = "") -> str:
    """A report on a question: passages, the analysis of the case, and what a model says if there is one."""
    stops = flows.silent_stops(made["steps"], facts.guards, facts.edges, made["rules"], facts.transitions)
    docs = tools.documents(made["use_cases"], made["entities"], made["steps"], stops, made["global_rules"], made["glossary"])
    hits = tools.search_or_keywords(points, docs, question)
    verdicts = steps = states = traces = None
    if shots is not None:
        verdicts, steps, states, traces = analyze(facts, made, shots)
    titles = made["use_cases"].select(F.col("page_id").alias("entry_id"), "title")
    lib = tools.Library(facts, pages, made["use_cases"], made["rules"], titles, docs, points, shots, verdicts, states)
    said, calls = None, []
    if model is not None:
        said, calls = tools.converse(model, question, lambda name, arguments: tools.answer(lib, name, arguments, case_id), tools.definitions(shots is not None))
    case: list[tuple[int, str]] = []
    if verdicts is not None and case_id is not None:
        one = [df.where(F.col("case_id") == case_id) for df in (verdicts, steps, traces, states)]
        case = case_report.of_case(case_report.lines(*one, made["rules"], facts.guards, titles, template, commit), case_id)
    return case_report.page(question, said, case, hits, calls)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["index", "check-index", "cards", "render", "publish", "search-index", "ask", "agent", "run"])
    parser.add_argument("words", nargs="*", help="the question, or the file of expected facts")
    parser.add_argument("--work", default="work")
    parser.add_argument("--facts")
    parser.add_argument("--config")
    parser.add_argument("--glossary", default="")
    parser.add_argument("--snapshot")
    parser.add_argument("--case", help="which case of the snapshot (else the first)")
    parser.add_argument("--template", default="")
    parser.add_argument("--out")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_intermixed_args(argv)
    chosen = settings.load(args.config, os.environ)
    spark = SparkSession.builder.getOrCreate()
    facts_path = args.facts or chosen.get("facts") or f"{args.work}/index.json"
    facts, counts = index(spark, facts_path)
    root, points_path = f"{args.work}/pages", f"{args.work}/points"
    if args.command == "index":
        print(f"index: {counts['entries']} entries, {counts['entities']} entities")
        return 0
    if args.command == "check-index":
        code, found = check_index(facts, args.words[0])
        for r in found.orderBy("id", "side", "line").toLocalIterator():
            print(f"{r.side}: {r.id} {r.line}")
        return code
    manual = fact_source.glossary(spark, args.glossary or f"{args.work}/glossary.json")
    made = make_cards(facts, manual, args.work)
    if args.command == "cards":
        print("cards: " + ", ".join(f"{made[n].count()} {n}" for n in ("use_cases", "entities", "flows", "global_rules", "modules")))
        return 0
    notes = page_notes(spark, root)
    pages = pages_of(facts, made, chosen.get("commit") or settings.commit_of(args.work), notes, args.template or chosen.get("template", ""))
    if args.command in ("render", "run"):
        print("render: " + ", ".join(f"{n} {k}" for k, n in write_pages(pages, root).items()))
    if args.command == "publish":
        if not args.dry_run:
            print("publish: give a client to sinks.publish, or use --dry-run", file=sys.stderr)
            return 2
        converted = render.storage(pages)
        print(f"publish (dry run): {sinks.publish(pages, pages.select('title').limit(0), 'v1', None, True)['create']} pages, {converted.where('length(storage) > 0').count()} converted")
    if args.command in ("search-index", "run"):
        print(f"search-index: {search_index(pages, points_path)} points")
    if args.command == "ask":
        points = read_points(spark, points_path)
        print(ask(points if points is not None else points_of(pages), " ".join(args.words)))
    if args.command == "agent":
        shots = snapshots.load(spark, args.snapshot) if args.snapshot else None
        case_id = None
        if shots is not None:
            wanted = shots.cases.where(F.col("case_id").cast("string") == args.case) if args.case else shots.cases
            first = wanted.orderBy("case_id").first()
            if first is None:
                print(f"agent: there is no case {args.case or ''}", file=sys.stderr)
                return 2
            case_id = first.case_id
        said = agent(facts, made, pages, read_points(spark, points_path), " ".join(args.words), shots, case_id, None, args.template or chosen.get("template", ""), chosen.get("commit") or "")
        if args.out:
            sinks.put(args.out, said)
        else:
            print(said)
    return 0


def page_notes(spark: SparkSession, root: str) -> DataFrame:
    """``path, notes`` of the page files below a folder that may not be there yet."""
    if not any(name.endswith(".md") for name in files.names(root, deep=True)):
        return spark.createDataFrame([], "path string, notes string")
    found = page_source.read_pages(spark, root)
    return page_source.with_notes(found, found).select("path", "notes")


if __name__ == "__main__":
    sys.exit(main())
