"""Connected components by alternating large-star and small-star.

Large-star: each node links its larger neighbours to the least of its neighbours and
itself. Small-star: each node links itself and its smaller neighbours to the least of
these. Both keep components, and they end in stars around the least nodes. Each step
is an aggregate and a join on the node, so no neighbourhood is gathered in one place;
edges are written to the shared folder between rounds, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges (u, v)`` that is not the least of its component.

    Nodes are of any type that has an order. Edges with a null end and loops are ignored;
    repeats and either direction are fine; no edges give no rows.
    """
    now = runtime.table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        before, now = now, runtime.table(_small_star(_large_star(now)), "edges")
        runtime.drop(now.sparkSession, before._shared_path)  # each round needs only the last
        after = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = after
