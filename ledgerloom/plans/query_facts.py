"""Driver queries: rules on case data, cards in code, usages, code and facts of types, on facts made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.plans import cards, tools
from ledgerloom.plans.catalog import query, read
from ledgerloom.sources import types
from ledgerloom.sources.facts import Facts

_GUARDS = [
    ("R1", 0, "R1G1", "if", "order.Status == OrderStatus.P", "fail:Pending", "Order.Status", "==", "OrderStatus.P"),
    ("R2", 0, "R2G1", "filter", "Where(o => o.Status == OrderStatus.F && o.Total >= 100000 && o.Id == id)", "filter", None, None, None),
    ("R2", 1, "R2G2", "if", "!orders.Any()", "silent_success", None, None, None),
    ("R3", 0, "R3G1", "if", '!flags.IsEnabledAsync("Pay")', "return", None, None, None),
    ("R4", 0, "R4G1", "rule", "RuleFor(x => x.Name).NotEmpty()", "validation", None, None, None),
    ("R4", 1, "R4G2", "if", "order.Total > 300_000m", "throw:Limit", "Order.Total", ">", "300_000m"),
]


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 < 2 THEN 'true' WHEN c_custkey % 4 = 2 THEN 'FALSE' END AS flag FROM customer),
o AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderstatus = 'P') AS d, bool_or(o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F' AND floor(o_totalprice) >= 100000) AS m,
  count(DISTINCT floor(o_totalprice) > 300000) AS e, bool_or(floor(o_totalprice) > 300000) AS big FROM orders GROUP BY o_custkey),
r AS (
  SELECT k, 'R1' AS rule_id, CASE WHEN d = 1 THEN p END AS a, NULL::BOOLEAN AS b, false AS two, false AS silent, CASE WHEN n IS NULL THEN 'table not fetched: Order' END AS lost, NULL AS said FROM c LEFT JOIN o USING (k)
  UNION ALL SELECT k, 'R2', m = 0, NULL, false, true, CASE WHEN n IS NULL THEN 'table not fetched: Order' END, CASE WHEN n IS NOT NULL THEN 'orders: ' || m || ' of ' || n || ' rows match' END FROM c LEFT JOIN o USING (k)
  UNION ALL SELECT k, 'R3', lower(flag) <> 'true', NULL, false, true, CASE WHEN flag IS NULL THEN 'no value for flag Pay' END, CASE WHEN flag IS NOT NULL THEN 'flag Pay = ' || flag END FROM c
  UNION ALL SELECT k, 'R4', NULL, CASE WHEN e = 1 THEN big END, true, false, CASE WHEN n IS NULL THEN 'table not fetched: Order' END, NULL FROM c LEFT JOIN o USING (k))
SELECT k AS c_custkey, rule_id, CASE WHEN coalesce(a, false) OR coalesce(b, false) THEN 'violated' WHEN NOT a AND NOT two THEN 'ok' ELSE 'unknown' END AS state, silent, coalesce(lost, '') AS missing, coalesce(said, '') AS said FROM r
""")
def rules_evaluate(spark, sf_dir):
    """Four rules on each customer's orders: a comparison over rows, a filter and a guard on it, a flag, and an input check beside a comparison."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    guards = spark.createDataFrame(_GUARDS, "rule_id string, pos int, guard_id string, kind string, condition string, exit string, left_side string, op string, right_side string")
    entities = spark.createDataFrame([("Order", "orders")], "entity string, table string")
    fields = spark.createDataFrame([("Order", "Status", "status"), ("Order", "Total", "total"), ("Order", "Id", "id")], "entity string, name string, column string")
    cases = customer.select(F.col("c_custkey").alias("case_id"))
    row = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("id"), F.col("o_orderkey").cast("string"))
    rows = orders.select(F.col("o_custkey").alias("case_id"), F.lit("orders").alias("table"), F.col("o_orderkey").alias("pos"), row.alias("row"))
    flag = F.when(F.col("c_custkey") % 4 < 2, "true").when(F.col("c_custkey") % 4 == 2, "FALSE")
    config = customer.select(F.col("c_custkey").alias("case_id"), F.lit("pay").alias("key"), flag.alias("value"))
    found = rules.evaluate(guards, entities, fields, cases, None, rows, config)
    said = F.array_join(F.filter("evidence", lambda e: e.startswith("flag ") | e.endswith("rows match")), "; ")
    return found.select(F.col("case_id").alias("c_custkey"), "rule_id", "state", "silent", F.array_join("missing", "; ").alias("missing"), said.alias("said"))


@query("""
WITH g AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'validation' WHEN 1 THEN 'return' ELSE 'filter' END AS exit, CASE WHEN turn % 4 = 3 THEN 'Other.Check' ELSE 'H.Handle' END AS via FROM conversations),
c AS (SELECT conv_id, role, min(turn) AS t, bool_or(exit <> 'validation' AND via = 'Other.Check') AS far FROM g GROUP BY ALL),
x AS (SELECT conv_id, exit, CASE exit WHEN 'validation' THEN '`Result.Fail` (validation)' WHEN 'return' THEN '`return`' ELSE 'the query finds nothing' END AS label, min(turn) AS t FROM g GROUP BY ALL),
xs AS (SELECT conv_id, CASE WHEN bool_or(exit <> 'filter') THEN string_agg(label, ' / ' ORDER BY t) FILTER (exit <> 'filter') ELSE string_agg(label, ' / ' ORDER BY t) END AS exits FROM x GROUP BY conv_id)
SELECT conv_id, (SELECT string_agg('`' || role || '`' || CASE WHEN far THEN ' in `Other.Check`' ELSE '' END, ', ' ORDER BY t) FROM c WHERE c.conv_id = xs.conv_id) AS condition, exits FROM xs
""")
def code_rules(spark, sf_dir):
    """Each conversation as a rule made of its turns: conditions by their text with foreign methods, and exits."""
    c = read(spark, sf_dir, "conversations")
    exit_ = F.when(F.col("turn") % 3 == 0, "validation").when(F.col("turn") % 3 == 1, "return").otherwise("filter")
    via = F.when(F.col("turn") % 4 == 3, "Other.Check").otherwise("H.Handle")
    entry = F.concat(F.lit("T:A.H`"), "conv_id")
    guards = c.select(entry.alias("entry_id"), F.concat(F.lit("G"), "turn").alias("guard_id"), F.col("role").alias("condition"), exit_.alias("exit"), via.alias("via"), F.concat(F.lit("f.cs:"), "turn").alias("location"), "turn")
    own = guards.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "guard_id"))), lambda s: s["guard_id"]).alias("guard_ids")).withColumn("no", F.lit(1))
    none = spark.createDataFrame([], "x int")
    facts = Facts(none, guards, none, none, none, none, none, none, none)
    found = cards.code_rules(facts, own)
    return found.select(F.substring("entry_id", 7, 40).cast("bigint").alias("conv_id"), "condition", "exits")


@query("""
WITH e AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'reads' ELSE 'reads_config' END AS type, 'Opt' || (p_size % 5) || '.P' || (p_partkey % 3) AS target, p_size % 5 AS o, p_partkey % 3 AS p FROM part)
SELECT p_partkey, type, CASE WHEN type = 'reads_config' AND o < 2 THEN 'Section' || o || ':P' || p ELSE target END AS target, CASE WHEN type = 'reads_config' AND o < 3 THEN CASE WHEN p = 0 THEN 'default ' || o END ELSE 'kept' END AS detail FROM e
""")
def config_keys(spark, sf_dir):
    """Options that parts read, by the sections that two of three options types are bound to."""
    target = F.concat(F.lit("Opt"), F.col("p_size") % 5, F.lit(".P"), F.col("p_partkey") % 3)
    edges = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "reads").otherwise("reads_config").alias("type"), target.alias("target"), F.lit("kept").alias("detail"))
    options = spark.createDataFrame([(f"Opt{o}", f"P{p}", str(o) if p == 0 else None) for o in range(3) for p in range(3)], "type string, property string, initializer string")
    return cards.config_keys(edges, options, spark.createDataFrame([("Opt0", "Section0"), ("Opt1", "Section1")], "type string, section string"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 50 + 1 AS start, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, unnest(generate_series(1, len(l))) AS i FROM d WHERE doc_id % 10 = 0 OR len(l) > 3)
SELECT doc_id, CAST(start + i - 1 AS BIGINT) AS line, sha256(regexp_replace(l[i], '\\r+$', '')) AS h FROM a
""")
def code_lines(spark, sf_dir):
    """Documents as source files: numbered lines of the chunk at an asked place (of every tenth, and of all with more than three lines)."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = F.size(F.split("text", "\n"))
    start = (F.col("doc_id") % 50 + 1).cast("int")
    path = F.concat(F.lit("d/"), "doc_id", F.lit(".cs"))
    chunks = d.select(F.lit("e").alias("entry_id"), F.col("doc_id").alias("pos"), path.alias("path"), start.alias("start_line"), (start + n - 1).alias("end_line"), "text")
    place = F.concat(path, F.lit(":"), F.when(n > 3, start + 3).otherwise(start))
    asked = d.where((F.col("doc_id") % 10 == 0) | (n > 3)).select(place.alias("location"))
    out = tools.code_lines(asked, chunks)
    return out.select(F.regexp_extract("location", "d/(-?[0-9]+)", 1).cast("bigint").alias("doc_id"), F.col("line").cast("bigint").alias("line"), F.sha2("text", 256).alias("h"))


_NAMES = ["Nation3", "nation5.f1", "F2", "Region.F0"]


@query("""
WITH e AS (SELECT 'S' || s_suppkey AS entry_id, ['reads', 'writes', 'insert', 'update', 'delete', 'sends'][s_suppkey % 6 + 1] AS type, 'Nation' || s_nationkey || '.F' || (s_suppkey % 3) AS target FROM supplier),
g AS (SELECT 'P' || p_partkey AS entry_id, 'x.F' || (p_size % 5) || ' > ' || p_size AS condition, 'Nation' || (p_size % 25) || '.F' || (p_partkey % 3) AS left_side FROM part)
SELECT n AS name, entry_id, 'edge' AS kind, type || ' ' || target AS line FROM e, (VALUES ('Nation3', 'nation3', NULL), ('nation5.f1', 'nation5', 'f1'), ('F2', 'f2', NULL), ('Region.F0', 'region', 'f0')) v(n, a, b)
WHERE type <> 'sends' AND CASE WHEN b IS NULL THEN lower(target) = a OR starts_with(lower(target), a || '.') OR ends_with(lower(target), '.' || a) ELSE lower(target) = a || '.' || b END
UNION ALL SELECT n, entry_id, 'guard', 'condition G1: `' || condition || '` → return @ f.cs:1' FROM g, (VALUES ('Nation3', 'nation3', NULL, 'Nation3'), ('nation5.f1', 'nation5', 'f1', 'f1'), ('F2', 'f2', NULL, 'F2'), ('Region.F0', 'region', 'f0', 'F0')) v(n, a, b, w)
WHERE CASE WHEN b IS NULL THEN lower(left_side) = a OR starts_with(lower(left_side), a || '.') OR ends_with(lower(left_side), '.' || a) ELSE lower(left_side) = a || '.' || b END OR regexp_matches(condition, '\\b' || w || '\\b')
""")
def usages(spark, sf_dir):
    """Edges and guards that use four asked names."""
    kinds = F.array(*[F.lit(x) for x in ("reads", "writes", "insert", "update", "delete", "sends")])
    edges = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entry_id"), F.lit(0).alias("pos"), F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("type"), F.concat(F.lit("Nation"), "s_nationkey", F.lit(".F"), F.col("s_suppkey") % 3).alias("target"), F.lit(None).cast("string").alias("detail"))
    condition = F.concat(F.lit("x.F"), F.col("p_size") % 5, F.lit(" > "), "p_size")
    guards = read(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entry_id"), F.lit(0).alias("pos"), F.lit("G1").alias("guard_id"), condition.alias("condition"), F.lit("return").alias("exit"), F.lit("f.cs:1").alias("location"), F.concat(F.lit("Nation"), F.col("p_size") % 25, F.lit(".F"), F.col("p_partkey") % 3).alias("left_side"))
    none = spark.createDataFrame([], "x int")
    entities = spark.createDataFrame([], "entity string, table string")
    moves = spark.createDataFrame([], "entity string, pos int, from_state string, to_state string, method string, location string")
    found = tools.find_usages(spark.createDataFrame([(n,) for n in _NAMES], "name string"), Facts(none, guards, edges, none, entities, none, moves, none, none))
    return found.select("name", "entry_id", "kind", "line")


@query("""
WITH t AS (SELECT p_partkey, p_size % 6 AS k, p_size % 10 = 0 AS s, p_size % 11 = 0 AS a FROM part)
SELECT p_partkey, CASE WHEN NOT s AND NOT a THEN CASE k WHEN 0 THEN 'validator' WHEN 1 THEN 'behavior' WHEN 2 THEN 'request_handler' WHEN 3 THEN 'event_handler' END END AS kind, NOT s AND k IN (0, 1, 2, 3) AND p_partkey % 2 = 0 AS entity, k = 4 AS event FROM t
""")
def type_kinds(spark, sf_dir):
    """Parts as types: the kind of their entry by what they implement, and whether they are entities or events."""
    names = F.array(F.array().cast("array<string>"), *[F.array(F.lit(x)) for x in ("X.IPipelineBehavior`2", "X.IRequestHandler`2", "X.INotificationHandler`1", "X.INotification", "X.IOther")])
    base = F.when(F.col("k") == 0, F.array(F.lit("V.AbstractValidator`1"))).when(F.col("k") == 5, F.array(F.lit("System.Exception")))
    p = read(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 6)
    t = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "A.Entities").otherwise("A.Jobs").alias("namespace"), (F.col("p_size") % 10 == 0).alias("is_static"), (F.col("p_size") % 11 == 0).alias("is_abstract"), F.element_at(names, (F.col("k") + 1).cast("int")).alias("interfaces"), base.alias("base_types"))
    return t.select("p_partkey", types.entry_kind().alias("kind"), types.is_entity([".Entities"]).alias("entity"), types.is_event().alias("event"))


@query("""
WITH g AS (SELECT user_id, event_id, event_type = 'error' AS fails, event_type = 'error' AND value > 50 AS same FROM events),
f AS (SELECT user_id, min((NOT same, event_id)) FILTER (fails) AS x FROM g GROUP BY user_id)
SELECT user_id, x[2] AS guard FROM f
""")
def first_guard(spark, sf_dir):
    """Of each user's errors the first with a large value, else the first."""
    e = read(spark, sf_dir, "events")
    guards = e.select(F.col("user_id").alias("method"), F.col("event_id").alias("pos"), F.when(F.col("value") > 50, "Status").otherwise("Kind").alias("field"), F.lit("!=").alias("op"), F.lit("S.Open").alias("right_side"), F.col("event_id").alias("condition"), F.when(F.col("event_type") == "error", "fail:X").otherwise("return").alias("exit"))
    writes = e.select(F.col("user_id").alias("method"), F.lit("Status").alias("field"))
    return types.first_guard(writes, guards).select(F.col("method").alias("user_id"), F.col("condition").alias("guard"))


@query("""
SELECT user_id, ['propagated', 'http', 'logged', 'used', 'ignored'][min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 4 ELSE 5 END)] AS detail FROM events GROUP BY user_id
""")
def result_handling(spark, sf_dir):
    """Users as sends: the strongest use of their results."""
    use = F.when(F.col("event_type") == "purchase", "propagated").when(F.col("event_type") == "signup", "http").when(F.col("event_type") == "error", "logged").when(F.col("event_type") == "click", "used")
    return types.result_handling(read(spark, sf_dir, "events").select(F.col("user_id").alias("send_id"), use.alias("use"))).withColumnRenamed("send_id", "user_id")


@query("""
WITH w AS (SELECT l_orderkey, arg_min(p, (-n, pos)) AS p FROM (SELECT l_orderkey, l_suppkey % 3 AS pos, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)
SELECT l_orderkey, p AS dependencies FROM w
""")
def widest_constructor(spark, sf_dir):
    """Of three lists of each order's parts the longest, the first of equally long ones."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("type_id"), (F.col("l_suppkey") % 3).alias("pos"))
    lists = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string")).alias("parameters"))
    return types.dependencies(lists).select(F.col("type_id").alias("l_orderkey"), F.array_join("dependencies", ",").alias("dependencies"))


@query("""
SELECT s_suppkey, 'N' || s_nationkey AS callee, coalesce('C' || c_custkey, 'N' || s_nationkey) AS target FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9900
""")
def implementations(spark, sf_dir):
    """Calls of a nation lead to its rich customers, where there are any."""
    calls = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("caller"), F.concat(F.lit("N"), "s_nationkey").alias("callee"))
    own = read(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("N"), "c_nationkey").alias("method"), F.concat(F.lit("C"), "c_custkey").alias("implementation"))
    return types.implementations(calls, own).withColumnRenamed("caller", "s_suppkey")


@query("""
WITH v AS (SELECT doc_id, CAST(doc_id % 7 AS DOUBLE) / 8 AS a, CAST(doc_id % 5 AS DOUBLE) / 4 AS b FROM documents)
SELECT doc_id AS query, 0 AS index, a AS score FROM v UNION ALL SELECT doc_id, 1, b FROM v
""")
def rerank_scores(spark, sf_dir):
    """Scores out of both forms of a reranker's answer."""
    d = read(spark, sf_dir, "documents")
    a, b = (F.col("doc_id") % 7).cast("double") / 8, (F.col("doc_id") % 5).cast("double") / 4
    item = lambda i, name, s: F.concat(F.lit(f'{{"index": {i}, "{name}": '), s.cast("string"), F.lit("}"))
    pair = lambda name: F.concat(F.lit("["), item(1, name, b), F.lit(", "), item(0, name, a), F.lit("]"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"results": '), pair("relevance_score"), F.lit("}"))).otherwise(pair("score"))
    return tools.rerank_scores(d.select(F.col("doc_id").alias("query"), answer.alias("json")))
