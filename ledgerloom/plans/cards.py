"""Offline cards: what the facts alone say of use cases, entities, global rules and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import joins, ordinals, sync
from ledgerloom.plans import flows
from ledgerloom.plans.flows import USE_CASES
from ledgerloom.sources.facts import Facts

#: Guards on technical ids are no business rules (fixed value: the form of such a condition).
TECHNICAL = "(?U)^RuleFor\\(\\w+ => \\w+\\.\\w*Id\\)\\.NotEmpty\\(\\)$"


def _entity_edges(facts: Facts) -> DataFrame:
    """Edges with the entity (first by id or short name) and the property that they touch."""
    name = F.when(F.col("target").startswith("T:"), scalars.short(F.col("target"))).otherwise(F.substring_index("target", ".", 1))
    keyed = facts.edges.withColumn("_row", F.concat_ws("\u0001", "entry_id", F.col("pos").cast("string"))).withColumn("_name", name)
    found = joins.or_lookup(keyed, facts.entities, "_row", [("target", "entity_id"), ("_name", "entity")], "entity_pos", ["entity", "table"])
    return found.drop("_row", "_name").withColumn("property", scalars.tail(F.col("target")))


def rules(facts: Facts) -> DataFrame:
    """``entry_id, no, guard_ids, conditions, on_fail``: business rules of each use case.

    Guards in execution order without passed-on errors and technical ids; a guard that
    repeats condition and exit of the one before it joins its rule; filters join the
    rule whose guard is the next on the same path.
    """
    own = facts.guards.join(facts.entries.where(F.col("kind").isin(*USE_CASES)).select("entry_id"), "entry_id", "left_semi")
    kept = own.where((F.col("exit") != "propagate") & ~F.col("condition").rlike(TECHNICAL))
    merged = ordinals.merge_adjacent(kept.where("kind <> 'filter'"), ["entry_id"], ["pos"], ["condition", "exit"])
    key = F.concat_ws("\u0001", "entry_id", "path")
    call = kept.where("kind = 'filter'").withColumn("_key", key).select("_key", "line", "entry_id", "pos", "guard_id", "condition", "exit")
    target = merged.withColumn("_key", key).select("_key", "line", "run")
    placed = joins.asof_forward(call, target, "_key", "line", "run").select("entry_id", "pos", "guard_id", "condition", "exit", F.col("next_value").alias("run")).where("run IS NOT NULL")
    every = merged.select("entry_id", "pos", "guard_id", "condition", "exit", "run", F.lit(1).alias("rank")).unionByName(placed.withColumn("rank", F.lit(0)))
    order = F.struct("rank", "pos")
    on_fail = scalars.exit_label(F.min_by("exit", F.when(F.col("rank") == 1, F.col("pos"))), F.lit(None).cast("string"), scalars.ON_FAIL)
    return every.groupBy("entry_id", F.col("run").cast("int").alias("no")).agg(ordinals.ordered_distinct(F.col("guard_id"), order).alias("guard_ids"), ordinals.ordered_join(F.col("condition"), order, ", ").alias("conditions"), on_fail.alias("on_fail"))


def coverage_errors(facts: Facts, used: DataFrame, dismissed: DataFrame) -> DataFrame:
    """``entry_id, guard_id, error``: guards that rules and dismissals (``entry_id, guard_id``) name never or twice."""
    key = F.concat_ws("\u0001", "entry_id", "guard_id").alias("key")
    bad = sync.exactly_once(facts.guards.where("exit <> 'propagate'").select(key), used.select(key).unionByName(dismissed.select(key)), "key")
    return bad.select(F.substring_index("key", "\u0001", 1).alias("entry_id"), F.substring_index("key", "\u0001", -1).alias("guard_id"), "error")


def effects(facts: Facts) -> DataFrame:
    """``entry_id, effects``: lines on what a use case creates, changes, deletes, publishes and starts."""
    e = _entity_edges(facts)
    inserted = e.where("type = 'insert' AND entity IS NOT NULL").select("entry_id", "entity").distinct()
    line = lambda df, rank, text: df.select("entry_id", F.lit(rank).alias("rank"), F.col("pos"), text.alias("line"))
    first = e.where("type = 'insert' AND entity IS NOT NULL").groupBy("entry_id", "entity").agg(F.min("pos").alias("pos"))
    creates = line(first, 0, F.concat(F.lit("Creates "), "entity", F.lit(".")))
    w = e.where("type = 'writes' AND entity IS NOT NULL").join(inserted, ["entry_id", "entity"], "left_anti")
    values = w.groupBy("entry_id", "entity", "property").agg(F.min("pos").alias("pos"), ordinals.ordered_join(F.concat(F.lit("`"), scalars.tail(F.col("detail")), F.lit("`")), F.col("pos"), " / ").alias("v"))
    shown = F.concat(F.lit("`"), "property", F.lit("`"), F.when(F.col("v") != "", F.concat(F.lit(" → "), "v")).otherwise(""))
    changed = values.groupBy("entry_id", "entity").agg(F.min("pos").alias("_p"), ordinals.ordered_join(shown, F.col("pos"), ", ").alias("v")).withColumnRenamed("_p", "pos")
    changes = line(changed, 1, F.concat(F.lit("Changes "), "entity", F.lit(": "), "v", F.lit(".")))
    deletes = line(e.where("type = 'delete' AND entity IS NOT NULL"), 2, F.concat(F.lit("Deletes "), "entity", F.lit(".")))
    publishes = line(e.where("type = 'publishes'"), 3, F.concat(F.lit("Publishes `"), scalars.short(F.col("target")), F.lit("`.")))
    handler = joins.handlers(facts.edges).groupBy("message").agg(F.min("handler").alias("handler"))
    sends = e.where("type = 'sends'").join(handler, F.col("target") == F.col("message"), "left")
    starts = line(sends, 4, F.when(F.col("handler").isNotNull(), F.concat(F.lit("Starts [[page:"), "handler", F.lit("]]."))).otherwise(F.concat(F.lit("Sends `"), scalars.short(F.col("target")), F.lit("`."))))
    every = creates
    for x in (changes, deletes, publishes, starts):
        every = every.unionByName(x)
    return every.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "line"))), lambda s: s["line"]).alias("effects"))


def data_rows(facts: Facts) -> DataFrame:
    """``entry_id, op, table, columns``: reads (but of what the use case itself inserts) and writes of each entity."""
    e = joins.lookup_default(_entity_edges(facts).where("entity IS NOT NULL").withColumn("_key", F.concat_ws(".", "entity", "property")), facts.fields.select(F.concat_ws(".", "entity", "name").alias("_key"), "column"), "_key", "column", F.col("property"))
    table = F.coalesce("table", "entity").alias("table")
    inserted = e.where("type = 'insert'").select("entry_id", "entity").distinct()
    reads = e.where("type = 'reads'").join(inserted, ["entry_id", "entity"], "left_anti").groupBy("entry_id", "entity", table).agg(F.array_join(ordinals.ordered_distinct(F.col("column"), F.col("pos")), ", ").alias("columns")).withColumn("op", F.lit("read"))
    has = lambda t: F.max(F.when(F.col("type") == t, 1)).isNotNull()
    writes = e.where("type IN ('writes', 'insert', 'update', 'delete')").groupBy("entry_id", "entity", table).agg(
        F.array_join(ordinals.ordered_distinct(F.when(F.col("type") == "writes", F.col("column")), F.col("pos")), ", ").alias("columns"), F.when(has("insert"), "insert").when(has("delete"), "delete").otherwise("update").alias("op")
    )
    return reads.unionByName(writes).select("entry_id", "op", "table", "columns")


def use_cases(facts: Facts) -> DataFrame:
    """``page_id, title, module, rules, effects, data, triggers`` of each use case."""
    own = facts.entries.where(F.col("kind").isin(*USE_CASES))
    title = scalars.humanize(scalars.strip_suffix(scalars.short(F.col("entry_id")), "CommandHandler", "QueryHandler", "EventHandler", "Handler"))
    r = rules(facts).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("no", "conditions", "on_fail", "guard_ids"))).alias("rules"))
    d = data_rows(facts).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("op", "table", "columns"))).alias("data"))
    t = joins.incoming(facts.edges).groupBy(F.col("handler").alias("entry_id")).agg(F.array_sort(F.collect_set("source")).alias("triggers"))
    out = own.join(r, "entry_id", "left").join(effects(facts), "entry_id", "left").join(d, "entry_id", "left").join(t, "entry_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(F.col("entry_id").alias("page_id"), title.alias("title"), "module", *[empty(c) for c in ("rules", "effects", "data", "triggers")])


def entities(facts: Facts) -> DataFrame:
    """``page_id, name, module, statuses, diagram, fields, performers`` of entities that use cases write or that have transitions."""
    touched = _entity_edges(facts).where("type IN ('writes', 'insert', 'update', 'delete') AND entity IS NOT NULL").select("entity")
    worth = facts.entities.join(touched.unionByName(facts.transitions.select("entity")).distinct(), "entity", "left_semi")
    states = ordinals.final_values(facts.transitions, ["entity"]).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("state", "is_final"))).alias("statuses"))
    lines = facts.transitions.groupBy("entity").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(scalars.state_id(F.coalesce("from_state", F.lit("[*]"))), F.lit(" --> "), scalars.state_id(F.col("to_state"))).alias("l")))), lambda s: s["l"])).alias("diagram"))
    fields = facts.fields.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type", F.coalesce("column", "name").alias("column")))), lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"), s["column"].alias("column"))).alias("fields"))
    w = facts.edges.where("type = 'writes'").select("entry_id", F.substring_index("target", ".", 1).alias("entity"), scalars.tail(F.col("target")).alias("field"), scalars.tail(F.col("detail")).alias("to_state"))
    performers = facts.transitions.join(w, ["entity", "field", "to_state"]).groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("to_state", "entry_id"))).alias("performers"))
    out = worth.join(states, "entity", "left").join(lines, "entity", "left").join(fields, "entity", "left").join(performers, "entity", "left")
    return out.select(F.concat(F.lit("entity:"), "entity").alias("page_id"), F.col("entity").alias("name"), "module", "statuses", "diagram", "fields", "performers")


def behavior_applies(facts: Facts) -> DataFrame:
    """``behavior, entry_id, no``: global rules of each request handler.

    By behavior edges if there are any; without any, every behavior is on every handler.
    A validation behavior needs a validator of the request.
    """
    linked = facts.edges.where("type = 'behavior'").select("entry_id", F.col("target").alias("behavior"))
    behaviors = facts.entries.where("kind = 'behavior'").select(F.col("entry_id").alias("behavior"))
    on = facts.entries.where("kind = 'request_handler'").select("entry_id")
    every = joins.attach_all(on, behaviors) if linked.isEmpty() else on.join(linked, "entry_id").join(behaviors, "behavior", "left_semi").select("entry_id", "behavior")
    request = joins.handlers(facts.edges).select(F.col("handler").alias("entry_id"), "message")
    validated = request.join(facts.edges.where("type = 'validates'").select(F.col("target").alias("message")), "message", "left_semi").select("entry_id", F.lit(True).alias("validated"))
    out = every.join(validated, "entry_id", "left").where(~F.col("behavior").rlike("(?i)validat") | F.col("validated"))
    return ordinals.numbered(out.select("behavior", "entry_id"), ["behavior"], ["entry_id"], "no")


def modules(facts: Facts) -> DataFrame:
    """``module, n_use_cases, depends_on``: by triggers and touched entities, other known modules only."""
    home = facts.entries.select("entry_id", "module")
    calls = joins.incoming(facts.edges).join(home.withColumnRenamed("entry_id", "handler").withColumnRenamed("module", "a"), "handler").join(home.withColumnRenamed("entry_id", "source").withColumnRenamed("module", "b"), "source").select("a", "b")
    data = _entity_edges(facts).join(home.withColumnRenamed("module", "a"), "entry_id").join(facts.entities.select("entity", F.col("module").alias("b")), "entity").select("a", "b")
    known = home.select(F.col("module").alias("b")).distinct()
    needs = calls.unionByName(data).where("a <> b").distinct().join(known, "b", "left_semi").groupBy(F.col("a").alias("module")).agg(F.array_sort(F.collect_set("b")).alias("depends_on"))
    counts = facts.entries.groupBy("module").agg(F.count_if(F.col("kind").isin(*USE_CASES)).alias("n_use_cases"))
    return counts.join(needs, "module", "left").select("module", "n_use_cases", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def glossary(facts: Facts, manual: DataFrame, collation: str = "pl_CI") -> DataFrame:
    """Terms: manual ones win over those of entities (names compared without case), in the order of a language."""
    proposed = facts.entities.select(scalars.humanize(F.col("entity")).alias("term"), F.col("entity").alias("code_name"), F.lit(None).cast("string").alias("meaning"))
    return joins.override_union(manual.select("term", "code_name", "meaning"), proposed, "code_name").orderBy(F.collate("term", collation), "term")


def link_errors(texts: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``page_id, error``: links of texts (``page_id, text``) to pages or code lines that don't exist."""
    token = "\\[\\[(page:[^\\]|]+|code:[^\\]|]+:\\d+)"
    each = texts.select("page_id", F.explode(F.regexp_extract_all("text", F.lit(token), F.lit(1))).alias("link")).distinct()
    to_page = each.where(F.col("link").startswith("page:")).withColumn("_id", F.substring("link", 6, 1 << 30)).join(pages.select(F.col("page_id").alias("_id")), "_id", "left_anti")
    code = each.where(F.col("link").startswith("code:")).withColumn("_loc", F.substring("link", 6, 1 << 30))
    code = code.withColumn("path", scalars.location_path(F.col("_loc"))).withColumn("line", scalars.location_line(F.col("_loc")))
    inside = joins.range_semi(code, chunks, "path", "line", "start_line", "end_line").select("page_id", "link")
    return to_page.select("page_id", F.concat(F.lit("unknown page "), "link").alias("error")).unionByName(code.select("page_id", "link").join(inside, ["page_id", "link"], "left_anti").select("page_id", F.concat(F.lit("no code at "), "link").alias("error")))


def numbering_errors(rules_: DataFrame) -> DataFrame:
    """Rules whose numbers are not 1, 2, 3 ..."""
    n = F.row_number().over(Window.partitionBy("entry_id").orderBy("no"))
    return rules_.withColumn("_n", n).where("no <> _n").select("entry_id", "no")


def code_rules(facts: Facts, rules_: DataFrame) -> DataFrame:
    """``entry_id, no, condition, exits, locations``: what a rule is in code.

    Conditions are grouped by their text, with the methods of other types that they are
    in; exits are those of the guards that are no filters, where there are any.
    """
    each = rules_.select("entry_id", "no", F.posexplode("guard_ids").alias("at", "guard_id")).join(facts.guards, ["entry_id", "guard_id"])
    home = F.regexp_extract(F.coalesce("via", F.lit("")), "^(.*)\\.[^.]*$", 1)
    foreign = F.when((F.col("exit") != "validation") & (home != scalars.short(F.col("entry_id"))), F.concat(F.lit("`"), "via", F.lit("`")))
    by_text = each.groupBy("entry_id", "no", "condition").agg(F.min("at").alias("first"), ordinals.ordered_distinct(foreign, F.col("at")).alias("via"))
    via = F.filter("via", lambda v: v.isNotNull())
    shown = F.concat(F.lit("`"), "condition", F.lit("`"), F.when(F.size(via) > 0, F.concat(F.lit(" in "), F.array_join(via, " / "))).otherwise(""))
    conditions = by_text.groupBy("entry_id", "no").agg(ordinals.ordered_join(shown, F.col("first"), ", ").alias("condition"))
    label = scalars.exit_label(F.col("exit"), F.lit(None).cast("string"), scalars.EXIT_LABELS)
    own = F.when(F.col("exit") != "filter", label)
    exits = each.groupBy("entry_id", "no").agg(ordinals.ordered_distinct(own, F.col("at")).alias("own"), ordinals.ordered_distinct(label, F.col("at")).alias("every"), ordinals.ordered_distinct(F.col("location"), F.col("at")).alias("locations"))
    plain = F.filter("own", lambda x: x.isNotNull())
    exits = exits.select("entry_id", "no", F.array_join(F.when(F.size(plain) > 0, plain).otherwise(F.col("every")), " / ").alias("exits"), "locations")
    return conditions.join(exits, ["entry_id", "no"])


def config_keys(edges: DataFrame, options: DataFrame, bindings: DataFrame) -> DataFrame:
    """Edges with the keys that ``reads_config`` edges mean.

    Targets ``Options.Property`` become ``Section:Property`` where the options type
    (``options``: ``type, property, initializer``) is bound to a section (``bindings``:
    ``type, section``); the initializer is told as the default. Other edges stay.
    """
    dot = F.instr("target", ".")
    read = (F.col("type") == "reads_config") & (dot > 0)
    e = edges.withColumn("_type", F.when(read, F.substring_index("target", ".", 1))).withColumn("_property", F.when(read, F.expr("substring(target, instr(target, '.') + 1)")))
    known = options.select(F.col("type").alias("_type")).distinct().withColumn("_known", F.lit(True))
    o = options.select(F.col("type").alias("_type"), F.col("property").alias("_property"), "initializer")
    out = e.join(known, "_type", "left").join(bindings.select(F.col("type").alias("_type"), "section"), "_type", "left").join(o, ["_type", "_property"], "left")
    key = F.when(F.col("section").isNotNull(), F.concat("section", F.lit(":"), "_property")).otherwise(F.col("target"))
    detail = F.when(F.col("initializer").isNotNull(), F.concat(F.lit("default "), "initializer"))
    said = F.coalesce("_known", F.lit(False))
    return out.withColumn("target", F.when(said, key).otherwise(F.col("target"))).withColumn("detail", F.when(said, detail).otherwise(F.col("detail"))).select(*edges.columns)


def config_rows(facts: Facts, meanings: DataFrame) -> DataFrame:
    """``entry_id, key, kind, default, meaning``: the configuration that each use case reads; ``meanings``: ``key, meaning`` by hand (keys without regard to case)."""
    read = facts.edges.where("type = 'reads_config'").select("entry_id", F.col("target").alias("key"), F.lower("target").alias("_key")).distinct()
    known = facts.config.select(F.lower("key").alias("_key"), "kind", "default").dropDuplicates(["_key"])
    said = meanings.select(F.lower("key").alias("_key"), "meaning").dropDuplicates(["_key"])
    return read.join(known, "_key", "left").join(said, "_key", "left").select("entry_id", "key", "kind", "default", "meaning")


def trigger_rows(facts: Facts) -> DataFrame:
    """``entry_id, source, maps``: who triggers each use case, with the mappings of the source that say more than a copy."""
    telling = facts.edges.where(F.col("type") == "maps").where(F.col("detail").rlike("[=<>!?(]"))
    maps = telling.groupBy(F.col("entry_id").alias("source")).agg(ordinals.ordered_join(F.concat(F.lit("`"), "target", F.lit("`: `"), "detail", F.lit("`")), F.col("pos"), "; ").alias("maps"))
    return joins.incoming(facts.edges).select(F.col("handler").alias("entry_id"), "source").distinct().join(maps, "source", "left").select("entry_id", "source", "maps")


def flow_cards(facts: Facts, steps: DataFrame, titles: DataFrame, rules_: DataFrame) -> DataFrame:
    """``page_id, title, modules, steps, nodes, edges, stops`` of each flow."""
    nodes, edges = flows.diagram(steps, facts.guards, titles)
    stops = flows.silent_stops(steps, facts.guards, facts.edges, rules_, facts.transitions)
    named = steps.join(titles, "entry_id", "left").join(facts.entries.select("entry_id", "module"), "entry_id", "left")
    every = named.groupBy(F.col("flow_id").alias("page_id")).agg(
        F.min_by(F.coalesce("title", "entry_id"), F.when(F.col("entry_id").isNotNull(), F.col("no"))).alias("title"),
        F.array_sort(F.collect_set("module")).alias("modules"),
        F.array_sort(F.collect_list(F.struct("no", "entry_id", F.coalesce("title", "external").alias("label"), "parent_no", "dashed"))).alias("steps"),
    )
    listed = lambda df, name, *columns: df.groupBy(F.col("flow_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = every.join(listed(nodes, "nodes", "id", "label", "shape"), "page_id", "left").join(listed(edges, "edges", "src", "dst", "label", "dashed"), "page_id", "left")
    return out.join(listed(stops, "stops", "no", "kind", "what", "rule"), "page_id", "left")


def global_rules(facts: Facts) -> DataFrame:
    """``page_id, title, location, logic, applies`` of each behavior."""
    own = facts.entries.where("kind = 'behavior'").select(F.col("entry_id").alias("page_id"), "location")
    label = scalars.exit_label(F.col("exit"), F.lit(None).cast("string"), scalars.EXIT_LABELS)
    logic = facts.guards.groupBy(F.col("entry_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "condition", label.alias("label"), "location"))).alias("logic"))
    on = behavior_applies(facts).groupBy(F.col("behavior").alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "entry_id"))), lambda x: x["entry_id"]).alias("applies"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = own.join(logic, "page_id", "left").join(on, "page_id", "left")
    return out.select("page_id", scalars.humanize(scalars.short(F.col("page_id"))).alias("title"), "location", empty("logic", "array<struct<pos:int,condition:string,label:string,location:string>>"), empty("applies", "array<string>"))


def system(modules_: DataFrame, flow_cards_: DataFrame, global_rules_: DataFrame) -> DataFrame:
    """One row: how many modules, use cases, flows and global rules there are, and the edges between modules."""
    needs = modules_.select(F.col("module").alias("a"), F.explode("depends_on").alias("b"))
    counts = modules_.agg(F.count(F.lit(1)).alias("n_modules"), F.coalesce(F.sum("n_use_cases"), F.lit(0)).alias("n_use_cases"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    arrows = needs.agg(F.array_sort(F.collect_set(F.concat("a", F.lit(" --> "), "b"))).alias("arrows"))
    return joins.attach_all(joins.attach_all(joins.attach_all(counts, one(flow_cards_, "n_flows")), one(global_rules_, "n_global_rules")), arrows)


def required_errors(cards_: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, error)`` of the fields that are null or blank."""
    blank = [F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.concat(F.lit(f), F.lit(" is missing"))) for f in fields]
    return cards_.select(key, F.explode(F.filter(F.array(*blank), lambda e: e.isNotNull())).alias("error"))


def catalogue(facts: Facts, steps: DataFrame) -> DataFrame:
    """``page_id, kind``: every page that there will be, known before any is made."""
    page = lambda df, kind, page_id: df.select(page_id.alias("page_id"), F.lit(kind).alias("kind"))
    out = page(facts.entries.where(F.col("kind").isin(*USE_CASES)), "use_case", F.col("entry_id"))
    out = out.unionByName(page(entities(facts), "entity", F.col("page_id"))).unionByName(page(steps, "flow", F.col("flow_id")))
    out = out.unionByName(page(facts.entries.where("kind = 'behavior'"), "global_rule", F.col("entry_id")))
    out = out.unionByName(page(facts.entries, "module", F.concat(F.lit("module:"), "module")))
    fixed = facts.entries.sparkSession.createDataFrame([("glossary", "glossary"), ("system", "system")], "page_id string, kind string")
    return out.unionByName(fixed).where("page_id IS NOT NULL").distinct()


def every_card(facts: Facts, manual: DataFrame) -> dict[str, DataFrame]:
    """All card tables by name; each is made of those before it."""
    own = rules(facts)
    u, e, steps = use_cases(facts), entities(facts), flows.discover(facts)
    titles = u.select(F.col("page_id").alias("entry_id"), "title")
    f, g, m = flow_cards(facts, steps, titles, own), global_rules(facts), modules(facts)
    return {"rules": own, "use_cases": u, "entities": e, "steps": steps, "flows": f, "global_rules": g, "modules": m, "glossary": glossary(facts, manual), "system": system(m, f, g), "catalogue": catalogue(facts, steps)}


def run_jobs(jobs: DataFrame, cache: DataFrame, complete, attempts: int = 3) -> DataFrame:
    """Answers of jobs ``(card_hash, prompt)``: from ``cache (card_hash, answer, status)``, else by ``complete``.

    ``complete(prompt, attempt, errors)`` gives ``(answer, error)`` and runs in Python workers,
    only for prompts that are not cached; it is told the errors of the attempts before.
    After the last attempt an answer that still has an error needs review; a job without
    any answer has status ``offline`` and is not to be cached.
    """
    missing = jobs.join(cache.select("card_hash"), "card_hash", "left_anti")

    def run(batches):
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                answer, error, errors = None, "no attempt", []
                for attempt in range(attempts):
                    try:
                        got, error = complete(prompt, attempt, list(errors))
                        answer = got if got is not None else answer
                    except Exception as problem:  # noqa: BLE001  a failing model is an error like any other
                        error = f"no valid answer: {problem}"
                    if error is None:
                        break
                    errors.append(error)
                out.append((answer, "offline" if answer is None else "ok" if error is None else "needs_review"))
            yield pdf.assign(answer=[a for a, _ in out], status=[s for _, s in out])[["card_hash", "answer", "status"]]

    made = missing.select("card_hash", "prompt").mapInPandas(run, "card_hash string, answer string, status string")
    return jobs.select("card_hash").join(cache, "card_hash").unionByName(made)


def cache_answers(made: DataFrame, cache: DataFrame, path: str) -> None:
    """Append new answers to the cache table; jobs without an answer are tried again in the next run."""
    made.where("answer IS NOT NULL").join(cache.select("card_hash"), "card_hash", "left_anti").write.mode("append").parquet(path)


def read_cache(spark, path: str) -> DataFrame:
    """``(card_hash, answer, status)`` of a cache table; empty where there is none yet."""
    schema = "card_hash string, answer string, status string"
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["card_hash"])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
