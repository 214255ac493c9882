"""Driver queries: conditions of source code, parsed and evaluated on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import conditions, predicates
from ledgerloom.operators import rules
from ledgerloom.plans.catalog import query, read

#: A condition about each order by its priority; ``{n}`` is half of its price.
_BY_PRIORITY = {
    "1-URGENT": "!(order.Total >= {n}m)",
    "2-HIGH": "order.Status is not OrderStatus.F",
    "3-MEDIUM": "!string.IsNullOrWhiteSpace(order.Clerk) && ({n} < order.Total || Check(order, x => x.Paid && x.Open))",
    "4-NOT SPECIFIED": "!(100_000 < order.Total || !(order.Status == OrderStatus.P))",
    "5-LOW": "(order.Total is > 50000 and <= 150000) || order.Status is null or OrderStatus.O",
}


def _conditions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").cast("bigint").alias("total"))
    text = F.element_at(F.create_map(*[F.lit(x) for pair in _BY_PRIORITY.items() for x in pair]), F.col("o_orderpriority"))
    text = F.replace(text, F.lit("{n}"), F.floor(F.col("total") / 2).cast("string"))
    return orders.withColumn("condition", text).withColumn("form", conditions.normal_form(F.col("condition")))


_ORDERS = "WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) AS t, CAST(floor(CAST(floor(o_totalprice) AS BIGINT) / 2) AS BIGINT) AS n FROM orders)\n"


@query(
    _ORDERS
    + """
SELECT o_orderkey,
  CASE p WHEN '1-URGENT' THEN 'order.Total < ' || n || 'm' WHEN '2-HIGH' THEN 'order.Status != OrderStatus.F'
    WHEN '3-MEDIUM' THEN 'order.Clerk is_not_empty; order.Total > ' || n || '; <Check(order, x => x.Paid && x.Open)>; or; and'
    WHEN '4-NOT SPECIFIED' THEN 'order.Total <= 100_000; order.Status == OrderStatus.P; and'
    WHEN '5-LOW' THEN 'order.Total > 50000; order.Total <= 150000; and; order.Status is_null; order.Status == OrderStatus.O; or; or' END AS form,
  CASE p WHEN '1-URGENT' THEN 'order.Total' WHEN '2-HIGH' THEN 'order.Status' END AS left_side, CASE p WHEN '1-URGENT' THEN '<' WHEN '2-HIGH' THEN '!=' END AS op,
  CASE p WHEN '1-URGENT' THEN n || 'm' WHEN '2-HIGH' THEN 'OrderStatus.F' END AS right_side
FROM o
"""
)
def condition_forms(spark, sf_dir):
    """The normal form of a condition about each order, and its structured form if it is a single comparison."""
    c = _conditions(spark, sf_dir)
    one = conditions.structured(F.col("form"))
    return c.select("o_orderkey", conditions.show(F.col("form")).alias("form"), one["left"].alias("left_side"), one["op"].alias("op"), one["right"].alias("right_side"))


@query(
    _ORDERS
    + """
SELECT o_orderkey, CASE p WHEN '1-URGENT' THEN t < n WHEN '2-HIGH' THEN s <> 'F' WHEN '3-MEDIUM' THEN CASE WHEN t > n THEN true END
  WHEN '4-NOT SPECIFIED' THEN t <= 100000 AND s = 'P' WHEN '5-LOW' THEN t > 50000 AND t <= 150000 OR s = 'O' END AS result FROM o
"""
)
def condition_results(spark, sf_dir):
    """Whether the condition about each order holds for it; unknown where it depends on a call."""
    c = _conditions(spark, sf_dir)
    value = lambda a: F.when(a["left"] == "order.Total", F.col("total").cast("string")).when(a["left"] == "order.Status", F.col("o_orderstatus")).when(a["left"] == "order.Clerk", F.lit("c"))
    result = conditions.holds(F.col("form"), lambda a, _: predicates.compare(value(a), a["op"], a["right"]))
    return c.select("o_orderkey", result.alias("result"))


_PARSED = [
    ("R1", 0, "R1G1", "if", "!(order.Status != OrderStatus.P)", "fail:Pending"),
    ("R2", 0, "R2G1", "if", "order.Total is > 300_000m or <= 20000", "throw:Limit"),
    ("R3", 0, "R3G1", "if", "!(event.Type != EventType.signup && order.Status is not OrderStatus.F)", "return"),
    ("R4", 0, "R4G1", "if", "order.Total > 100000 && Check(order)", "fail:Checked"),
    ("R5", 0, "R5G1", "if", "Check(order)", "fail:Checked"),
]


@query("""
WITH o AS (
  SELECT o_custkey AS k, CASE WHEN count(DISTINCT o_orderstatus = 'P') = 1 THEN bool_or(o_orderstatus = 'P') END AS p, CASE WHEN count(DISTINCT o_orderstatus = 'F') = 1 THEN bool_or(o_orderstatus = 'F') END AS f,
    CASE WHEN count(DISTINCT floor(o_totalprice) > 300000) = 1 THEN bool_or(floor(o_totalprice) > 300000) END AS big, CASE WHEN count(DISTINCT floor(o_totalprice) <= 20000) = 1 THEN bool_or(floor(o_totalprice) <= 20000) END AS small,
    CASE WHEN count(DISTINCT floor(o_totalprice) > 100000) = 1 THEN bool_or(floor(o_totalprice) > 100000) END AS mid
  FROM orders GROUP BY o_custkey),
e AS (SELECT user_id AS k, CASE WHEN count(DISTINCT event_type = 'signup') = 1 THEN bool_or(event_type = 'signup') END AS s FROM events GROUP BY user_id),
c AS (SELECT c_custkey AS k, p, f, big, small, mid, s FROM customer LEFT JOIN o ON c_custkey = o.k LEFT JOIN e ON c_custkey = e.k),
r AS (SELECT k, 'R1' AS rule_id, p AS r FROM c UNION ALL SELECT k, 'R2', big OR small FROM c UNION ALL SELECT k, 'R3', s OR f FROM c UNION ALL SELECT k, 'R4', mid AND NULL FROM c UNION ALL SELECT k, 'R5', NULL FROM c)
SELECT k AS c_custkey, rule_id, CASE WHEN r THEN 'violated' WHEN NOT r THEN 'ok' ELSE 'unknown' END AS state FROM r
""")
def conditions_by_rules(spark, sf_dir):
    """Rules whose conditions are only text, parsed and evaluated on the orders and events of each customer."""
    customer, orders, events = (read(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    guards = spark.createDataFrame(_PARSED, "rule_id string, pos int, guard_id string, kind string, condition string, exit string")
    guards = rules.structure(guards.select("*", *[F.lit(None).cast("string").alias(c) for c in ("left_side", "op", "right_side")]))
    entities = spark.createDataFrame([("Order", "orders"), ("Event", "events")], "entity string, table string")
    fields = spark.createDataFrame([("Order", "Status", "status"), ("Order", "Total", "total"), ("Event", "Type", "type")], "entity string, name string, column string")
    one = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), F.floor("o_totalprice").cast("bigint").cast("string"))
    rows = orders.select(F.col("o_custkey").alias("case_id"), F.lit("orders").alias("table"), F.col("o_orderkey").alias("pos"), one.alias("row"))
    rows = rows.unionByName(events.select(F.col("user_id").alias("case_id"), F.lit("events").alias("table"), F.col("event_id").alias("pos"), F.create_map(F.lit("type"), F.col("event_type")).alias("row")))
    config = spark.createDataFrame([], "case_id bigint, key string, value string")
    cases = customer.select(F.col("c_custkey").alias("case_id"))
    found = rules.evaluate(guards, entities, fields, cases, None, rows, config, parse=True)
    return found.select(F.col("case_id").alias("c_custkey"), "rule_id", "state")
