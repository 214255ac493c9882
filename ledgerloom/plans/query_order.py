"""Driver queries: numbering, runs, first matches, top k and diagnosis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import diagnose, ordinals
from ledgerloom.plans.catalog import query, read


@query("SELECT conv_id, turn, 'G' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS guard, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS contiguous FROM conversations")
def numbering(spark, sf_dir):
    """Turns numbered in order, and whether their own numbers have no gap."""
    c = read(spark, sf_dir, "conversations")
    n = ordinals.numbered(c, ["conv_id"], ["turn"], "guard", "G")
    return n.select("conv_id", "turn", "guard", (F.col("turn") == F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("contiguous"))


@query("SELECT conv_id, role, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def first_by(spark, sf_dir):
    """The first turn of each role in each conversation."""
    return ordinals.first_by(read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"])


_RUNS = """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM d),
r AS (SELECT l_orderkey, min(n) AS low, max(n) AS high FROM i GROUP BY l_orderkey, g)
"""


@query(_RUNS + "SELECT l_orderkey, low, high FROM r")
def islands(spark, sf_dir):
    """Runs of consecutive line numbers."""
    return ordinals.runs(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(_RUNS + """
, p AS (SELECT l_orderkey, list(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || '–' || high END ORDER BY low) AS x FROM r GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(x) = 1 THEN x[1] ELSE array_to_string(x[1:len(x) - 1], ', ') || ' and ' || x[len(x)] END AS text FROM p
""")
def island_text(spark, sf_dir):
    """The runs as text."""
    return ordinals.run_text(ordinals.runs(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber"), ["l_orderkey"])


@query("""
WITH c AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT user_id, run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, run
""")
def merge_adjacent(spark, sf_dir):
    """Neighbouring events of one type are one group."""
    m = ordinals.merge_adjacent(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return m.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


def _steps(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "not_done").otherwise("no_trace")
    outcome = F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.concat(F.lit("Rejected "), "event_id"))
    return ordinals.numbered(e.withColumn("state", state).withColumn("outcome", outcome), ["user_id"], ["ts", "event_id"], "no")


@query("""
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, event_type = 'purchase' AS done, event_type = 'error' AS missed, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'Rejected ' || event_id END AS outcome FROM events),
b AS (SELECT *, min(CASE WHEN missed AND before THEN no END) OVER (PARTITION BY user_id) AS break_no FROM (SELECT *, coalesce(bool_or(done) OVER (PARTITION BY user_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM s))
SELECT user_id, CAST(coalesce(min(break_no), 0) AS BIGINT) AS break_no, CAST(coalesce(max(no) FILTER (done AND no < break_no), 0) AS BIGINT) AS last_done, CAST(count(*) FILTER (done) AS BIGINT) AS n_done, arg_max(outcome, no) FILTER (outcome IS NOT NULL) AS negative FROM b GROUP BY user_id
""")
def break_step(spark, sf_dir):
    """The first step not done after a done one, the last done before it and the last negative outcome."""
    b = ordinals.breaks(_steps(spark, sf_dir), "user_id", "no", "state", "outcome")
    return b.select("user_id", F.coalesce("break_no", F.lit(0)).cast("bigint").alias("break_no"), F.col("last_done").cast("bigint").alias("last_done"), "n_done", "negative")


@query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn - 1 END AS parent FROM conversations)
SELECT conv_id, turn FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.conv_id = t.conv_id AND c.parent = t.turn)
""")
def leaf_steps(spark, sf_dir):
    """Turns that no answer follows."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("turn") - 1).alias("parent"))
    return ordinals.leaves(t, ["conv_id"], "turn", "parent").select("conv_id", "turn")


@query("""
SELECT c_mktsegment, c_custkey, CAST(rank AS BIGINT) AS rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5
""")
def topk_stable(spark, sf_dir):
    """The five largest balances of each segment, ties by key."""
    t = ordinals.top(read(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    return t.select("c_mktsegment", "c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT user_id, arg_min(event_id, ts) AS first_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_of_type(spark, sf_dir):
    """The first purchase of each user."""
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_id"))


@query("""
WITH s AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
t AS (SELECT DISTINCT user_id, event_type AS f, nxt AS t FROM s WHERE nxt IS NOT NULL AND nxt <> event_type)
SELECT DISTINCT user_id, t AS state, NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = t.user_id AND x.f = t.t) AS is_final FROM t
""")
def final_states(spark, sf_dir):
    """Event types that a user's history changes to; final if it never leaves them."""
    e = read(spark, sf_dir, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = e.select("user_id", F.col("event_type").alias("from_state"), following.alias("to_state")).where("to_state IS NOT NULL AND to_state <> from_state")
    return ordinals.final_values(t, ["user_id"])


#: A process of five steps; the fourth is outside of the data, the fifth leaves no trace.
_PROCESS = ["signup", "click", "purchase", None, "view"]


@query("""
WITH p(no, step) AS (VALUES (1, 'signup'), (2, 'click'), (3, 'purchase'), (4, NULL), (5, 'view')),
u AS (SELECT user_id, user_id IN (SELECT user_id FROM events WHERE value < 1) AS low FROM events GROUP BY user_id),
f AS (SELECT user_id, event_type, count(*) AS n, bool_or(value > 90) AS done, bool_or(value < 5) AS unk FROM events GROUP BY user_id, event_type),
s AS (SELECT u.user_id, no, CASE WHEN step IS NULL THEN 'external' WHEN n IS NULL THEN 'no_trace' WHEN done THEN 'done' WHEN unk THEN 'unknown' ELSE 'not_done' END AS state FROM u, p LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = step),
b AS (SELECT user_id, min(no) FILTER (state = 'not_done' AND no > fd) AS break_no FROM (SELECT *, min(CASE WHEN state = 'done' THEN no END) OVER (PARTITION BY user_id) AS fd FROM s) GROUP BY user_id),
k AS (SELECT s.user_id, CAST(min(break_no) AS BIGINT) AS break_no, count(*) FILTER (state = 'done') AS n_done, coalesce(bool_or(state = 'external' AND no < break_no), false) AS external, count(*) FILTER (state = 'unknown') AS n_unknown FROM s JOIN b USING (user_id) GROUP BY s.user_id)
SELECT user_id, coalesce(break_no, 0) AS break_no, CAST(n_done AS BIGINT) AS n_done, CASE WHEN n_done = 0 THEN 'insufficient_data' WHEN external THEN 'outside_code' WHEN break_no IS NOT NULL AND n_unknown > 0 THEN 'candidates' WHEN break_no IS NOT NULL THEN 'insufficient_data' ELSE 'no_problem_found' END AS verdict FROM k
""")
def diagnose_steps(spark, sf_dir):
    """Each user as a case of one process: states of its steps, the break and the verdict."""
    e = read(spark, sf_dir, "events")
    seen = e.groupBy("user_id", F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") > 90).alias("done"), F.bool_or(F.col("value") < 5).alias("unk"))
    plan = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(s).cast("string").alias("step")) for i, s in enumerate(_PROCESS)])
    every = e.select("user_id").distinct().select("user_id", F.explode(plan).alias("p")).select("user_id", "p.no", "p.step").join(seen, ["user_id", "step"], "left")
    state = diagnose.step_state(F.col("step").isNotNull(), F.lit(True), F.coalesce("n", F.lit(0)), F.coalesce("done", F.lit(False)), F.coalesce("unk", F.lit(False)))
    steps = every.select(F.col("user_id").alias("case_id"), F.lit("flow").alias("flow_id"), "no", state.alias("state"), F.lit(None).cast("string").alias("outcome"))
    unknown = steps.groupBy("case_id").agg(F.count_if(F.col("state") == "unknown").alias("n_unknown"))
    checks = diagnose.flow_checks(steps).join(unknown, "case_id")
    said = F.when(F.col("n_done") == 0, "insufficient_data").otherwise(diagnose.verdict(F.lit(0), F.col("n_unknown"), F.col("negative"), F.col("external"), F.col("break_no")))
    return checks.select(F.col("case_id").alias("user_id"), F.coalesce("break_no", F.lit(0)).cast("bigint").alias("break_no"), "n_done", said.alias("verdict"))


#: The same process as facts: entries that insert rows or write the status of a purchase.
_ENTRIES = ["e1", "e2", "e3", None, "e5"]
_EDGES = [("e1", 0, "insert", "signup", None), ("e2", 0, "insert", "click", None), ("e3", 0, "writes", "purchase.state", "State.Paid"), ("e3", 1, "writes", "purchase.state", "State.Rejected"), ("e5", 0, "insert", "view", None)]
_TRANSITIONS = [("purchase", "state", None, "Open"), ("purchase", "state", "Open", "Paid"), ("purchase", "state", "Open", "Rejected")]


@query("""
WITH u AS (SELECT user_id, coalesce(max(value) FILTER (event_type = 'signup') > 60, false) AS s1, coalesce(max(value) FILTER (event_type = 'click') > 100, false) AS s2, coalesce(max(value) FILTER (event_type = 'purchase') > 100, false) AS s3, coalesce(max(value) FILTER (event_type = 'view') > 150, false) AS s5,
  coalesce(max(value) FILTER (event_type = 'error'), 0) AS err, (min((ts, event_id)) FILTER (event_type = 'purchase' AND value > 150))[2] AS rejected FROM events GROUP BY user_id),
s AS (SELECT user_id, no, CASE WHEN no = 4 THEN 'external' WHEN no = 5 AND user_id % 5 = 0 THEN 'unknown' WHEN CASE no WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s5 END THEN 'done' ELSE 'not_done' END AS state FROM u, (VALUES (1), (2), (3), (4), (5)) p(no)),
b AS (SELECT user_id, min(no) FILTER (state = 'not_done' AND no > fd) AS break_no FROM (SELECT *, min(CASE WHEN state = 'done' THEN no END) OVER (PARTITION BY user_id) AS fd FROM s) GROUP BY user_id),
k AS (SELECT user_id, min(break_no) AS break_no, count(*) FILTER (state = 'done') AS n_done, coalesce(max(no) FILTER (state = 'done' AND no < break_no), 0) AS last_done, coalesce(bool_or(state = 'external' AND no < break_no), false) AS external FROM s JOIN b USING (user_id) GROUP BY user_id),
r AS (SELECT user_id, 2 AS no, 'R1' AS rule, CASE WHEN err > 120 THEN 'violated' WHEN err > 60 THEN 'ok' ELSE 'unknown' END AS state FROM u UNION ALL SELECT user_id, 3, 'R2', CASE WHEN user_id % 3 = 0 THEN 'unknown' WHEN err > 150 THEN 'violated' ELSE 'ok' END FROM u UNION ALL SELECT user_id, 5, 'R3', CASE WHEN err > 180 THEN 'violated' ELSE 'ok' END FROM u),
c AS (SELECT user_id, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (state = 'violated'), '') AS causes, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (state = 'unknown'), '') AS candidates FROM k JOIN r USING (user_id) WHERE r.no > last_done AND r.no <= break_no GROUP BY user_id),
x AS (SELECT user_id, break_no, n_done, external, coalesce(causes, '') AS causes, coalesce(candidates, '') AS candidates, 'purchase.state = Rejected (event_id = ' || rejected || ', state = REJECTED)' AS negative FROM k JOIN u USING (user_id) LEFT JOIN c USING (user_id))
SELECT user_id, CAST(coalesce(break_no, 0) AS BIGINT) AS break_no, causes, candidates, coalesce(negative, '') AS negative,
  CASE WHEN n_done = 0 THEN 'insufficient_data' WHEN causes <> '' THEN 'cause_found' WHEN negative IS NOT NULL OR external THEN 'outside_code' WHEN break_no IS NOT NULL AND candidates <> '' THEN 'candidates' WHEN break_no IS NOT NULL THEN 'insufficient_data' ELSE 'no_problem_found' END AS verdict FROM x
""")
def diagnose_causes(spark, sf_dir):
    """Each user as a case whose rows, statuses and rules are looked at: violated rules, negative outcomes and the verdict."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "case_id").withColumnRenamed("event_type", "entity")
    flow = spark.createDataFrame([("flow", i + 1, x) for i, x in enumerate(_ENTRIES)], "flow_id string, no int, entry_id string")
    entries = flow.where("entry_id IS NOT NULL").select("entry_id")
    edges = spark.createDataFrame(_EDGES, "entry_id string, pos int, type string, target string, detail string")
    transitions = spark.createDataFrame(_TRANSITIONS, "entity string, field string, from_state string, to_state string")
    cases = e.select("case_id").distinct()
    entity = F.explode(F.array(*[F.lit(x) for x in _PROCESS if x])).alias("entity")
    placed = cases.select("case_id", entity).withColumn("snap_table", F.when(~((F.col("entity") == "view") & (F.col("case_id") % 5 == 0)), F.col("entity")))
    in_case = e.where("entity = 'purchase' OR value > CASE entity WHEN 'signup' THEN 60 WHEN 'click' THEN 100 WHEN 'view' THEN 150 END")
    status = F.when(F.col("entity") == "purchase", F.when(F.col("value") > 150, "REJECTED").when(F.col("value") > 100, "Paid").otherwise("Open"))
    rows = ordinals.numbered(in_case.withColumn("status", status), ["case_id", "entity"], ["ts", "event_id"], "pos")
    rows = rows.select("case_id", "entity", "pos", "status", F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("state"), F.col("status")).alias("row"))
    none = F.lit(None).cast("string")
    values = rows.select("case_id", "entity", "pos", "row", none.alias("field"), none.alias("value")).unionByName(rows.where("status IS NOT NULL").select("case_id", "entity", "pos", "row", F.lit("state").alias("field"), F.col("status").alias("value")))
    steps = diagnose.steps(flow, entries, cases, diagnose.effects(edges, transitions, placed, values), diagnose.outcomes(edges, transitions, values))
    errors = e.groupBy("case_id").agg(F.coalesce(F.max(F.when(F.col("entity") == "error", F.col("value"))), F.lit(0.0)).alias("err"))
    err = F.col("err")
    r1 = F.when(err > 120, "violated").when(err > 60, "ok").otherwise("unknown")
    r2 = F.when(F.col("case_id") % 3 == 0, "unknown").when(err > 150, "violated").otherwise("ok")
    r3 = F.when(err > 180, "violated").otherwise("ok")
    states = F.explode(F.array(*[F.struct(F.lit(entry).alias("entry_id"), F.lit(rule).alias("rule_id"), state.alias("state")) for entry, rule, state in (("e2", "R1", r1), ("e3", "R2", r2), ("e5", "R3", r3))]))
    rule_states = errors.select("case_id", states.alias("r")).select("case_id", "r.*", F.array().cast("array<string>").alias("missing"))
    found = diagnose.analyze(cases, diagnose.flow_checks(steps), steps, rule_states)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select(F.col("case_id").alias("user_id"), F.coalesce("break_no", F.lit(0)).cast("bigint").alias("break_no"), joined("causes"), joined("candidates"), F.coalesce("negative", F.lit("")).alias("negative"), "verdict")
