"""Which step of a process did not happen, and why: flows against case data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import graph, joins, ordinals


def status_writes(edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(entry_id, pos, entity, field, value)``: constant writes to fields that have transitions (names without regard to case, given as the transitions have them)."""
    w = edges.where((F.col("type") == "writes") & F.col("detail").rlike("^\\w+\\.\\w+$"))
    w = w.select("entry_id", "pos", F.substring_index("target", ".", 1).alias("entity"), scalars.tail(F.col("target")).alias("field"), scalars.tail(F.col("detail")).alias("value"))
    known = transitions.groupBy(F.lower("entity").alias("_entity"), F.lower("field").alias("_field")).agg(F.min(F.struct("entity", "field")).alias("own"))
    found = w.join(known, (F.lower("entity") == F.col("_entity")) & (F.lower("field") == F.col("_field")))
    return found.select("entry_id", "pos", "own.entity", "own.field", "value")


def reachable(transitions: DataFrame, starts: DataFrame) -> DataFrame:
    """``(entity, field, value, state)``: a written status and all that follow it (compared without case). A later status proves the step too."""
    key = lambda v: F.struct("entity", "field", F.lower(F.col(v)).alias("state"))
    edges = transitions.where("from_state IS NOT NULL").select(key("from_state").alias("src"), key("to_state").alias("dst")).distinct()
    s = starts.select("entity", "field", "value", key("value").alias("start")).distinct()
    found = graph.closure(edges, s.select("start"))
    return s.join(found, "start").select("entity", "field", "value", F.col("node.state").alias("state"))


def step_state(known: Column, indexed: Column, n: Column, any_done: Column, any_unknown: Column) -> Column:
    """State of a step from its effects: external, unknown, no_trace, done, unknown, not_done, in this order."""
    return F.when(~known, "external").when(~indexed, "unknown").when(n == 0, "no_trace").when(any_done, "done").when(any_unknown, "unknown").otherwise("not_done")


def effects(edges: DataFrame, transitions: DataFrame, placed: DataFrame, values: DataFrame) -> DataFrame:
    """``(case_id, entry_id, state, evidence)``: traces of an entry in a case's data; state null if the table is missing.

    ``placed``: ``case_id, entity, snap_table``; ``values``: ``case_id, entity, field,
    value`` for each row and for fields with transitions, with ``field`` null for rows as such.
    """
    counts = values.where("field IS NULL").groupBy("case_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    inserts = edges.where("type = 'insert'").select("entry_id", F.lower("target").alias("_entity")).distinct()
    placed = placed.withColumn("_entity", F.lower("entity"))
    i = inserts.join(placed, "_entity").join(counts, ["case_id", "entity"], "left")
    found = i.select("case_id", "entry_id", F.when(F.col("snap_table").isNotNull(), F.coalesce("n", F.lit(0)) > 0).alias("state"), F.concat("entity", F.lit(": "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows")).alias("evidence"))
    writes = status_writes(edges, transitions)
    w = writes.withColumn("_entity", F.lower("entity")).join(inserts, ["entry_id", "_entity"], "left_anti").join(placed.drop("entity"), "_entity")
    reached = reachable(transitions, writes)
    v = values.where("field IS NOT NULL").select("case_id", "entity", "field", F.lower("value").alias("state"))
    hit = v.join(reached, ["entity", "field", "state"]).select("case_id", "entity", "field", "value").distinct().withColumn("hit", F.lit(True))
    written = w.join(hit, ["case_id", "entity", "field", "value"], "left")
    written = written.select("case_id", "entry_id", F.when(F.col("snap_table").isNotNull(), F.coalesce("hit", F.lit(False))).alias("state"), F.concat("entity", F.lit("."), "field", F.lit(" -> "), "value").alias("evidence"))
    return found.unionByName(written)


def outcomes(edges: DataFrame, transitions: DataFrame, values: DataFrame) -> DataFrame:
    """``(case_id, entry_id, outcome)``: the first status that an entry writes, that tells of a failure and that a row of the case holds (compared without case).

    ``values`` as for effects, with the ``pos`` of the row and the ``row`` as a map. The
    outcome shows the first such row's cells that are not null. Entries without one have no row.
    """
    written = status_writes(edges, transitions).where(scalars.is_negative(F.col("value")))
    written = written.select("entry_id", F.col("pos").alias("write_pos"), "entity", "field", F.lower("value").alias("_key"), F.concat("entity", F.lit("."), "field", F.lit(" = "), "value").alias("text"))
    held = values.where("field IS NOT NULL").select("case_id", "entity", "field", F.lower("value").alias("_key"), "pos", "row")
    cells = F.transform(F.map_entries(F.map_filter("row", lambda _, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
    text = F.concat("text", F.lit(" ("), F.array_join(cells, ", "), F.lit(")"))
    return held.join(written, ["entity", "field", "_key"]).groupBy("case_id", "entry_id").agg(F.min_by(text, F.struct("write_pos", "pos")).alias("outcome"))


def steps(flow_steps: DataFrame, entries: DataFrame, cases: DataFrame, found: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """``(case_id, flow_id, no, entry_id, state, outcome)``: the state of every step of every flow in every case.

    ``negative``: the outcomes; without them there is no column ``outcome``.
    """
    known = entries.select(F.col("entry_id").alias("_known")).distinct()
    every = joins.attach_all(cases.select("case_id"), flow_steps.select("flow_id", "no", "entry_id").join(known, F.col("entry_id") == F.col("_known"), "left"))
    seen = found.groupBy("case_id", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("state"), F.lit(False)).alias("done"), F.bool_or(F.col("state").isNull()).alias("unknown"))
    both = every.join(seen, ["case_id", "entry_id"], "left")
    state = step_state(F.col("entry_id").isNotNull(), F.col("_known").isNotNull(), F.coalesce("n", F.lit(0)), F.coalesce("done", F.lit(False)), F.coalesce("unknown", F.lit(False)))
    out = both.select("case_id", "flow_id", "no", "entry_id", state.alias("state"))
    return out if negative is None else out.join(negative.select("case_id", "entry_id", "outcome"), ["case_id", "entry_id"], "left").select(*out.columns, "outcome")


def flow_checks(step_states: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row for each case and flow: done steps, last done step, break, negative outcome, external step before the break."""
    keyed = step_states.withColumn("_key", F.concat_ws("\u0001", "case_id", "flow_id"))
    b = ordinals.breaks(keyed, "_key", "no", "state", outcome)
    facts = keyed.join(b.select("_key", "break_no", "last_done", "n_done", "negative"), "_key")
    return facts.groupBy("case_id", "flow_id").agg(
        F.first("break_no").alias("break_no"), F.first("last_done").alias("last_done"), F.first("n_done").alias("n_done"), F.first("negative").alias("negative"), F.coalesce(F.bool_or((F.col("state") == "external") & (F.col("no") < F.col("break_no"))), F.lit(False)).alias("external")
    )


def pick_flow(checks: DataFrame) -> DataFrame:
    """The flow to explain: with a break or a negative outcome and most steps done, else the first with a step done."""
    problem = F.col("break_no").isNotNull() | F.col("negative").isNotNull()
    order = [F.when(problem, 0).otherwise(1), F.when(problem, -F.col("n_done")).otherwise(0), F.col("flow_id")]
    return checks.where("n_done > 0").withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where("_r = 1").drop("_r")


def verdict(violated: Column, unknown: Column, negative: Column, external: Column, break_no: Column) -> Column:
    """What is to be said of a case: the first that holds."""
    return (
        F.when(violated > 0, "cause_found")
        .when(negative.isNotNull() | external, "outside_code")
        .when(break_no.isNotNull() & (unknown > 0), "candidates")
        .when(break_no.isNotNull(), "insufficient_data")
        .otherwise("no_problem_found")
    )


def analyze(cases: DataFrame, checks: DataFrame, step_states: DataFrame, rule_states: DataFrame) -> DataFrame:
    """``(case_id, flow_id, verdict, break_no, causes, candidates, missing)``.

    ``rule_states``: ``case_id, entry_id, rule_id, state, missing``. Rules of the steps
    after the last done one up to the break are looked at. A case without any done step
    has insufficient data.
    """
    flow = pick_flow(checks)
    between = step_states.join(flow, ["case_id", "flow_id"]).where((F.col("no") > F.col("last_done")) & (F.col("no") <= F.col("break_no"))).select("case_id", "flow_id", "no", "entry_id")
    looked = between.join(rule_states, ["case_id", "entry_id"])
    by = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("rule_id"))))
    rules = looked.groupBy("case_id").agg(by("violated").alias("causes"), by("unknown").alias("candidates"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("state") == "unknown", F.col("missing")))))).alias("missing"))
    out = cases.select("case_id").join(flow, "case_id", "left").join(rules, "case_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    none = F.array().cast("array<string>")
    said = F.when(F.col("flow_id").isNull(), "insufficient_data").otherwise(verdict(F.greatest(n("causes"), F.lit(0)), F.greatest(n("candidates"), F.lit(0)), F.col("negative"), F.col("external"), F.col("break_no")))
    return out.select("case_id", "flow_id", said.alias("verdict"), "break_no", "negative", F.coalesce("causes", none).alias("causes"), F.coalesce("candidates", none).alias("candidates"), F.coalesce("missing", none).alias("missing"))
