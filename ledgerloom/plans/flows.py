"""Processes: chains of entries along what they send and publish, as tables and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import graph, joins, ordinals
from ledgerloom.sources.facts import Facts

USE_CASES = ("request_handler", "event_handler")


def _steps_of(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Depth-first steps ``root, node, parent, no``. A message that nothing handles is a step of its own each time."""
    out = joins.outgoing(edges)
    dst = F.coalesce("handler", F.concat_ws("\u0001", F.lit("external"), "message", "source", F.col("pos").cast("string")))
    ordered = out.select(F.col("source").alias("src"), dst.alias("dst"), F.row_number().over(Window.partitionBy("source").orderBy("pos", F.col("handler").asc_nulls_first())).alias("pos"))
    return graph.chain(ordered, roots)


def discover(facts: Facts) -> DataFrame:
    """``flow_id, no, entry_id, external, parent_no, dashed``: chains of two use cases or more.

    Roots are endpoints and use cases that nothing triggers. A chain that inserts an
    entity is continued (dashed) by other endpoints whose first use case writes it.
    """
    entries, edges = facts.entries, facts.edges
    use_cases = entries.where(F.col("kind").isin(*USE_CASES)).select("entry_id")
    endpoints = entries.where("kind = 'endpoint'").select("entry_id")
    triggered = joins.incoming(edges).select(F.col("handler").alias("entry_id"))
    roots = endpoints.withColumn("endpoint", F.lit(True)).unionByName(use_cases.join(triggered, "entry_id", "left_anti").withColumn("endpoint", F.lit(False)))
    steps = _steps_of(edges, roots.select(F.col("entry_id").alias("root"))).join(roots.withColumnRenamed("entry_id", "root"), "root")
    steps = steps.where(~F.col("endpoint") | (F.col("no") > 1)).withColumn("no", F.when(F.col("endpoint"), F.col("no") - 1).otherwise(F.col("no")))
    external = F.col("node").startswith("external\u0001")
    steps = graph.cut(steps.select("root", "endpoint", "no", F.when(~external, F.col("node")).alias("entry_id"), F.when(external, F.element_at(F.split("node", "\u0001"), 2)).alias("external"), "node", F.when(~F.col("endpoint") | (F.col("parent") != F.col("root")), F.col("parent")).alias("parent")))
    flows = steps.groupBy("root").agg(F.count("entry_id").alias("n"), F.max("no").alias("last")).where("n >= 2")
    main = graph.cut(steps.join(flows, "root"))

    entity_of = F.substring_index(F.when(F.col("target").startswith("T:"), F.substring_index("target", ".", -1)).otherwise(F.col("target")), ".", 1)
    inserted = edges.where("type = 'insert'").select("entry_id", entity_of.alias("entity")).join(facts.entities.select("entity"), "entity", "left_semi")
    written = edges.where("type IN ('writes', 'update')").select("entry_id", entity_of.alias("entity"))
    flow_inserts = main.join(inserted, "entry_id").select("root", "entity").distinct()
    first = joins.outgoing(edges).join(endpoints.withColumnRenamed("entry_id", "source"), "source", "left_semi").where("handler IS NOT NULL").groupBy("source").agg(F.min_by("handler", F.struct("pos", "handler")).alias("first"))
    writers = first.join(written, F.col("first") == F.col("entry_id")).select("source", "first", "entity").distinct()
    more = flow_inserts.join(writers, "entity").where("source <> root").select("root", "source", "first").distinct()
    more = more.join(main.select("root", F.col("entry_id").alias("first")), ["root", "first"], "left_anti")
    tail = steps.where("endpoint").select(F.col("root").alias("source"), F.col("no").alias("own_no"), "entry_id", "external", "node", "parent")
    added = more.join(tail, "source").join(main.select("root", "entry_id").where("entry_id IS NOT NULL"), ["root", "entry_id"], "left_anti")
    turn = Window.partitionBy("root", "node").orderBy("source")
    added = added.withColumn("_t", F.row_number().over(turn)).where("_t = 1").join(flows.select("root", "last"), "root")
    added = graph.cut(added.withColumn("no", F.col("last") + F.row_number().over(Window.partitionBy("root").orderBy("source", "own_no"))))
    every = main.select("root", "no", "entry_id", "external", "node", "parent", F.lit(False).alias("dashed"), "last").unionByName(added.select("root", "no", "entry_id", "external", "node", "parent", F.lit(True).alias("dashed"), "last"))
    up = every.select("root", F.col("node").alias("parent"), F.col("no").alias("parent_no"))
    out = every.join(up, ["root", "parent"], "left")
    return graph.cut(out.select(F.concat(F.lit("flow:"), "root").alias("flow_id"), "no", "entry_id", "external", F.coalesce("parent_no", F.when(F.col("dashed"), F.col("last"))).alias("parent_no"), "dashed"))


def diagram(steps: DataFrame, guards: DataFrame, titles: DataFrame, yes: str = "yes", no: str = "no", stop: str = "End without further steps", end: str = "End of process") -> tuple[DataFrame, DataFrame]:
    """Nodes ``(flow_id, id, label, shape)`` and edges ``(flow_id, src, dst, label, dashed)`` of each flow.

    A step whose entry may return early and has followers gets a decision; leaves lead
    to the end.
    """
    labelled = steps.join(titles.select("entry_id", "title"), "entry_id", "left").withColumn("label", F.coalesce("title", "external"))
    returns = guards.where("exit = 'return'").groupBy("entry_id").agg(ordinals.ordered_join(F.col("condition"), F.col("pos"), " or ").alias("asked"))
    parents = steps.where("parent_no IS NOT NULL").select("flow_id", F.col("parent_no").alias("no")).distinct().withColumn("leads", F.lit(True))
    s = labelled.join(returns, "entry_id", "left").join(parents, ["flow_id", "no"], "left")
    s = graph.cut(s.withColumn("decides", F.col("asked").isNotNull() & F.coalesce("leads", F.lit(False))))
    made = s.select("flow_id", F.col("no").cast("bigint").alias("no"), F.explode(F.when(F.col("decides"), F.array(F.struct(F.lit(0).alias("k"), F.col("label").alias("text"), F.lit("step").alias("shape")), F.struct(F.lit(1).alias("k"), F.concat("asked", F.lit("?")).alias("text"), F.lit("decision").alias("shape")), F.struct(F.lit(2).alias("k"), F.lit(stop).alias("text"), F.lit("end").alias("shape")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("label").alias("text"), F.lit("step").alias("shape"))))).alias("n")).select("flow_id", "no", "n.*")
    last = s.groupBy("flow_id").agg((F.max("no") + 1).cast("bigint").alias("no")).select("flow_id", "no", F.lit(0).alias("k"), F.lit(end).alias("text"), F.lit("end").alias("shape"))
    nodes = ordinals.numbered(made.unionByName(last), ["flow_id"], ["no", "k"], "n")
    nodes = graph.cut(nodes.select("flow_id", "no", "k", ordinals.node_letter(F.col("n")).alias("id"), F.col("text").alias("label"), "shape"))
    at = lambda k, name: nodes.where(F.col("k") == k).select("flow_id", "no", F.col("id").alias(name))
    exits = s.select("flow_id", "no", "decides").join(at(0, "own"), ["flow_id", "no"]).join(at(1, "decision"), ["flow_id", "no"], "left").select("flow_id", "no", F.coalesce("decision", "own").alias("exit"), "decides")
    into = s.where("parent_no IS NOT NULL").join(exits.select("flow_id", F.col("no").alias("parent_no"), F.col("exit").alias("src"), F.col("decides").alias("asked_before")), ["flow_id", "parent_no"]).join(at(0, "dst"), ["flow_id", "no"])
    out = into.select("flow_id", "src", "dst", F.when(F.col("asked_before"), F.lit(no)).alias("label"), "dashed")
    decided = s.where("decides").join(at(0, "a"), ["flow_id", "no"]).join(at(1, "b"), ["flow_id", "no"]).join(at(2, "c"), ["flow_id", "no"])
    none = F.lit(None).cast("string")
    out = out.unionByName(decided.select("flow_id", F.col("a").alias("src"), F.col("b").alias("dst"), none.alias("label"), F.lit(False).alias("dashed")))
    out = out.unionByName(decided.select("flow_id", F.col("b").alias("src"), F.col("c").alias("dst"), F.lit(yes).alias("label"), F.lit(False).alias("dashed")))
    ends = nodes.join(last.select("flow_id", F.col("no").alias("_last")), "flow_id").where("no = _last").select("flow_id", F.col("id").alias("dst"))
    leaf = exits.join(parents.select("flow_id", "no"), ["flow_id", "no"], "left_anti").join(ends, "flow_id")
    out = out.unionByName(leaf.select("flow_id", F.col("exit").alias("src"), "dst", none.alias("label"), F.lit(False).alias("dashed")))
    return nodes.select("flow_id", "id", "label", "shape"), out


def silent_stops(steps: DataFrame, guards: DataFrame, edges: DataFrame, rules: DataFrame | None = None, transitions: DataFrame | None = None) -> DataFrame:
    """``flow_id, no, kind, what, rule``: places where a process ends without an error.

    ``guard``: silent guards, a row for each rule that owns some (the first of the step's
    ``rules``, ``entry_id, no, guard_ids, conditions``, that names a guard), with the
    rule's conditions, and one for those that no rule owns. ``swallowed``: results of sends
    that are only logged or ignored. ``final_status``: constant writes of a status that
    tells of a failure and that no transition leaves. Without ``rules`` no guard is owned,
    without ``transitions`` no status is known.
    """
    own = steps.where("entry_id IS NOT NULL").select("flow_id", "no", "entry_id")
    none = F.lit(None).cast("int")
    silent = own.join(guards.where("exit IN ('silent_success', 'return')").select("entry_id", "pos", "guard_id", "condition"), "entry_id")
    if rules is None:
        silent = silent.withColumn("owner", F.struct(none.alias("rule"), F.lit(None).cast("string").alias("conditions")))
    else:
        named = rules.select("entry_id", F.struct(F.col("no").cast("int").alias("rule"), "conditions").alias("owner"), F.explode("guard_ids").alias("guard_id"))
        silent = silent.join(named.groupBy("entry_id", "guard_id").agg(F.min("owner").alias("owner")), ["entry_id", "guard_id"], "left")
    silent = silent.groupBy("flow_id", "no", F.col("owner.rule").alias("rule")).agg(F.coalesce(F.first("owner.conditions", True), ordinals.ordered_join(F.col("condition"), F.col("pos"), ", ")).alias("what"))
    silent = silent.select("flow_id", "no", F.lit("guard").alias("kind"), "what", "rule")
    swallowed = own.join(edges.where("type = 'sends' AND detail IN ('logged', 'ignored')"), "entry_id").select("flow_id", "no", F.lit("swallowed").alias("kind"), F.col("target").alias("what"), none.alias("rule"))
    out = silent.unionByName(swallowed)
    if transitions is None:
        return out
    entity = F.when(F.col("target").startswith("T:"), scalars.short(F.col("target"))).otherwise(F.substring_index("target", ".", 1))
    written = edges.where("type = 'writes' AND detail IS NOT NULL").select("entry_id", "target", entity.alias("entity"), scalars.tail(F.col("detail")).alias("state"))
    failed = ordinals.final_values(transitions, ["entity"]).where(F.col("is_final") & scalars.is_negative(F.col("state"), scalars.FAILED_STATUS)).select("entity", "state")
    final = own.join(written.join(failed, ["entity", "state"]), "entry_id")
    return out.unionByName(final.select("flow_id", "no", F.lit("final_status").alias("kind"), F.concat("target", F.lit(" = "), "state").alias("what"), none.alias("rule")))
