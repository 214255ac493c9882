"""Driver queries: closures, depths and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.plans.catalog import query, read

_EDGES = """
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey + 1),
"""


def _edges(spark, sf_dir):
    """Nations lead to their region, regions to the nations of the next."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    down = region.select(F.concat(F.lit("r"), "r_regionkey").alias("src"), (F.col("r_regionkey") + 1).alias("n_regionkey")).join(nation, "n_regionkey").select("src", F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return up.unionByName(down)


@query(_EDGES + "c AS (SELECT DISTINCT src AS start, src AS node FROM e UNION SELECT start, dst FROM c JOIN e ON node = src) SELECT start, node FROM c")
def closure(spark, sf_dir):
    """All that each node reaches."""
    e = _edges(spark, sf_dir)
    return graph.closure(e, e.select(F.col("src").alias("start"))).select("start", "node")


@query(_EDGES + """
c AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e UNION SELECT start, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 4)
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY start, node
""")
def call_closure(spark, sf_dir):
    """What each node reaches within four steps, and how soon."""
    e = _edges(spark, sf_dir)
    return graph.closure(e, e.select(F.col("src").alias("start")), 4).withColumn("depth", F.col("depth").cast("bigint"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id || '/' || turn AS id, CASE WHEN role = 'assistant' THEN conv_id || '/' || (turn - 1) END AS parent FROM conversations),
d AS (SELECT id, 0 AS depth FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, depth + 1 FROM t JOIN d ON t.parent = d.id)
SELECT id, CAST(depth AS BIGINT) AS depth FROM d
""")
def tree_depth(spark, sf_dir):
    """Depth of each turn in the forest of answers."""
    t = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("role") == "assistant", F.concat_ws("/", "conv_id", F.col("turn") - 1)).alias("parent"))
    return graph.depths(t).select("id", F.col("depth").cast("bigint").alias("depth"))


@query("""
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS src, n_nationkey AS pos, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || n_nationkey, s_suppkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey),
w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, CAST([] AS INT[]) AS path, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT root, dst, list_append(path, CAST(pos AS INT)), node FROM w JOIN e ON node = src),
f AS (SELECT root, node, parent, path, row_number() OVER (PARTITION BY root, node ORDER BY path) AS k FROM w)
SELECT root, node, parent, CAST(row_number() OVER (PARTITION BY root ORDER BY path) AS BIGINT) AS no FROM f WHERE k = 1
""")
def chain(spark, sf_dir):
    """Depth-first numbering from each region over nations to suppliers."""
    nation = read(spark, sf_dir, "nation")
    a = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.col("n_nationkey").cast("int").alias("pos"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.col("s_suppkey").cast("int").alias("pos"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return graph.chain(a.unionByName(s), roots).select("root", "node", "parent", F.col("no").cast("bigint").alias("no"))
