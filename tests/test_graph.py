"""Closures, depths and chains that are longer than any bound they had."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.plans import query_graph


def test_closure_has_no_bound(spark):
    assert inspect.signature(graph.closure).parameters["most"].default is None  # a way of over 1,000 edges takes minutes
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(8, 0), (3, 3)], "src int, dst int")
    starts = spark.createDataFrame([(0,), (6,)], "start int")
    got = {(r.start, r.node): r.depth for r in graph.closure(edges, starts).collect()}
    assert got == {(s, n): (n - s) % 9 for s in (0, 6) for n in range(9)}
    assert graph.closure(edges, starts, 2).count() == 6


def test_chain_is_whole_or_an_error(spark):
    edges = spark.createDataFrame([(f"n{i}", 0, f"n{i + 1}") for i in range(53)] + [("n53", 0, "n0")], "src string, pos int, dst string")
    roots = spark.createDataFrame([("n0",)], "root string")
    assert [(r.node, r.no) for r in graph.chain(edges, roots).orderBy("no").collect()] == [(f"n{i}", i + 1) for i in range(54)]
    few = edges.where("src IN ('n0', 'n1', 'n2')")
    assert graph.chain(few, roots, 3).count() == 4
    with pytest.raises(ValueError):
        graph.chain(few, roots, 2)


def test_tree_depth_of_a_long_conversation(spark, tmp_path):
    rows = [(1, i, "user" if i == 0 else "assistant", "x") for i in range(104)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: r.depth for r in query_graph.tree_depth(spark, str(tmp_path)).collect()}
    assert got == {f"1/{i}": i for i in range(104)}


def _walk(edges, root):
    out, order, parents = {}, [root], {root: None}
    for s, _, d in sorted(edges):
        out.setdefault(s, []).append(d)

    def visit(x):
        for y in out.get(x, ()):
            if y not in parents:
                parents[y] = x
                order.append(y)
                visit(y)

    visit(root)
    return order, parents


def _reach(edges, start):
    depth, front = {start: 0}, [start]
    while front:
        front = [d for s, d in edges if s in front and d not in depth]
        depth |= {d: max(depth.values()) + 1 for d in front}
    return depth


@pytest.mark.parametrize("growth", [8, 0.5])  # with doubled steps, and where they grow too many
def test_closure_and_chain_of_random_graphs(spark, monkeypatch, growth):
    monkeypatch.setattr(graph, "GROWTH", growth)
    r = random.Random(6)
    edges, roots = [], []
    for g in range(12):  # graphs beside each other, so that they are one job
        n = r.randint(2, 14)
        own = {(100 * g + r.randrange(n), 100 * g + r.randrange(n)) for _ in range(r.randint(1, 3 * n))}
        places = r.sample(range(1000), len(own))
        edges += [(s, p, d) for (s, d), p in zip(sorted(own), places)]
        roots += [100 * g + r.randrange(n) for _ in range(2)]
    df = spark.createDataFrame(edges, "src int, pos int, dst int")
    starts = sorted(set(roots))
    got = {(x.start, x.node): x.depth for x in graph.closure(df, spark.createDataFrame([(x,) for x in starts], "start int")).collect()}
    pairs = [(s, d) for s, _, d in edges]
    assert got == {(s, n): d for s in starts for n, d in _reach(pairs, s).items()}
    rows = graph.chain(df, spark.createDataFrame([(x,) for x in starts], "root int")).orderBy("root", "no").collect()
    for root in starts:
        order, parents = _walk(edges, root)
        own = [x for x in rows if x.root == root]
        assert [x.node for x in own] == order and {x.node: x.parent for x in own} == parents and [x.no for x in own] == list(range(1, len(order) + 1))


def _count_cuts(monkeypatch):
    calls, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: calls.append(1) or real(df))
    return calls


def test_layers_take_no_exponential_time(spark):
    """Thirty layers of two nodes, each joined with both of the next: 2**30 ways."""
    edges = spark.createDataFrame([(2 * i + a, 2 * i + a, 2 * (i + 1) + b) for i in range(30) for a in (0, 1) for b in (0, 1)], "src int, pos int, dst int")
    got = graph.chain(edges, spark.createDataFrame([(0,)], "root int")).orderBy("no").collect()
    assert len(got) == 61 and [x.node for x in got[:31]] == [0, *range(2, 62, 2)]


def test_ten_thousand_levels_take_few_rounds(spark, monkeypatch):
    n = 10_000
    calls = _count_cuts(monkeypatch)
    nodes = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")).unionByName(spark.createDataFrame([(-1, -2), (-2, -1), (-3, -1), (-5, -99)], "id bigint, parent bigint"))
    got = {r.id: r.depth for r in graph.depths(nodes).collect()}
    assert all(got[i] == i for i in range(n)) and got[-1] == got[-2] == got[-3] == n + 4 and got[-5] == 0 and len(calls) <= 16
    calls.clear()
    chain = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    far = graph.closure(chain, spark.createDataFrame([(0,)], "start bigint"))
    assert far.count() == n and far.where("depth = node").count() == n and len(calls) <= 2 + 2 * 15
