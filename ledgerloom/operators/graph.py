"""Closures, depths and depth-first chains.

Closure and depth are loops of joins whose reach doubles and that end when nothing new
is found, so cycles are fine. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """End a lineage by a checkpoint, in the folder that driver and executors share.

    A cluster must name it in ``spark.checkpoint.dir``; one machine (a local master) gets
    a temporary folder where none is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ledgerloom-checkpoints-"))
    return df.checkpoint()


#: Steps are doubled as long as there are at most so many for each edge and each pair that was found.
GROWTH = 8


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``(start, node, depth)``: all nodes that each ``start`` reaches, itself at depth 0, by the shortest way.

    ``edges``: ``src, dst``. After each round twice as many edges are covered: the nodes
    that were found last are joined with steps of a length, and then each step with the
    steps that follow it, so a way of n edges takes about log n rounds. Where steps grow
    beyond ``GROWTH`` times what there is (dense graphs), their length stays and rounds
    go on with it. ``most`` bounds the depth where that is asked for (a call closure).
    """
    seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    steps = cut(edges.select("src", "dst").distinct())
    length, covered, doubling = 1, 1, True
    n_edges, n_seen = steps.count(), seen.count()
    while most is None or covered <= most:
        last = seen.where(F.col("depth") >= covered - length)
        found = last.join(steps, last.node == steps.src).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.col("depth") + length).alias("depth"))
        new = cut(found.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        n_new = new.count()
        if not n_new:
            break
        seen, n_seen, covered = seen.unionByName(new), n_seen + n_new, covered + length
        if doubling and (most is None or covered <= most):
            onward = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
            twice = cut(steps.join(onward, "dst").select("src", F.col("to").alias("dst")).distinct())
            doubling = twice.count() <= GROWTH * max(n_edges, n_seen)
            if doubling:
                steps, length = twice, 2 * length
    return seen if most is None else seen.where(F.col("depth") <= most)


def depths(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Depth of each node of a forest ``(id, parent)``; a cycle ends at the number of nodes (or ``most``). Unknown parents count as roots.

    Each round every node takes over the pointer of the node that it points to, so
    pointers double their reach: n levels take about log n rounds.
    """
    n = nodes.count()
    bound = n if most is None else most
    known = nodes.select(F.col("id").alias("_known"))
    state = cut(nodes.join(known, nodes.parent == known["_known"], "left").select("id", F.col("_known").alias("up"), F.when(F.col("_known").isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(n.bit_length() + 1):
        going = state.where("up IS NOT NULL")
        if going.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        jumped = going.join(above, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = cut(state.where("up IS NULL").unionByName(jumped))
    ended = F.when(F.col("up").isNull(), F.least("depth", F.lit(bound))).otherwise(bound)
    return state.select("id", ended.cast("int").alias("depth"))


def chain(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """Depth-first numbering from each root: ``(root, node, path, parent, no)``.

    ``edges``: ``src, pos, dst``; ``path`` has the places of the edges from the root on,
    ``no`` counts from 1 in the order of first visits, the root first; edges of one place
    go by ``dst``. What a root reaches is found by a closure; its edges are then walked
    with a stack, once each, in one group for each root: the order of visits is sequential
    by nature. A group is as large as what its root reaches. Where a guard ``most`` is
    given, longer paths are an error.
    """
    reach = closure(edges, roots.select(F.col("root").alias("start")).distinct()).select(F.col("start").alias("root"), F.col("node").alias("src"))
    own = reach.join(edges.select("src", F.col("pos").cast("int").alias("pos"), "dst"), "src", "left").select("root", "src", "pos", "dst")
    kind = own.schema["root"].dataType.simpleString()

    def walk(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        type_ = group.column("root").type
        out: dict = {}
        for s, p, d in sorted(zip(*(group.column(c).to_pylist() for c in ("src", "pos", "dst"))), key=lambda e: (e[1] is None, e[1], e[2]) if e[2] is not None else (True, 0, 0)):
            if d is not None:
                out.setdefault(s, []).append((p, d))
        root = group.column("root")[0].as_py()
        seen, nodes, parents, paths = {root}, [root], [None], [[]]
        stack = [(root, [], iter(out.get(root, ())))]
        while stack:
            at, path, ways = stack[-1]
            for place, to in ways:
                if to not in seen:
                    seen.add(to)
                    nodes.append(to)
                    parents.append(at)
                    paths.append([*path, place])
                    stack.append((to, paths[-1], iter(out.get(to, ()))))
                    break
            else:
                stack.pop()
        n = len(nodes)
        return pa.table([pa.array([root] * n, type_), pa.array(nodes, type_), pa.array(paths, pa.list_(pa.int32())), pa.array(parents, type_), pa.array(range(1, n + 1), pa.int32())], ["root", "node", "path", "parent", "no"])

    found = cut(own.groupBy("root").applyInArrow(walk, f"root {kind}, node {kind}, path array<int>, parent {kind}, no int"))
    if most is not None and not found.where(F.size("path") > most).isEmpty():
        raise ValueError(f"a chain has more than {most} edges")
    return found


def shared_folder(spark, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; one machine gets a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-shared-")
    return f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
