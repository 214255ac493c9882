"""Functions and operators on small tables, against plain Python."""

import random
import re
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import predicates, scalars, text
from ledgerloom.operators import graph, joins, ordinals, retrieval, rules, sync

ACTUAL = [None, "", " ", "abc", "ABC", "25000", "+5", "7-", "1,000", "1e5", "true", "FALSE", " 12 ", "-3.50", "."]
RIGHT = [None, "null", '"abc"', "20_000m", "1", "-7", "1000", "KycStatus.Verified", "true", "12", "-3.5M"]


def number(x):
    if x is None or not re.match(r"^\s*([+-]?[0-9][0-9,]*(\.[0-9]*)?|[+-]?\.[0-9]+|[0-9][0-9,]*(\.[0-9]*)?[+-])\s*$", x):
        return None
    x = x.strip().replace(",", "")
    return Decimal(x[-1] + x[:-1] if x[-1] in "+-" else x)


def plain(actual, op, right):
    if op == "is_null" or op == "is_not_null":
        return (actual is None) == (op == "is_null")
    if op == "is_empty" or op == "is_not_empty":
        return (actual is None or not actual.strip()) == (op == "is_empty")
    if op == "is_true" or op == "is_false":
        return None if actual is None else actual.lower() == op[3:]
    expected = right
    if right in (None, "null"):
        expected = None
    elif right.startswith('"'):
        expected = right.strip('"')
    elif number(right.rstrip("mM").replace("_", "")) is not None:
        expected = right.rstrip("mM").replace("_", "")
    else:
        expected = right.rsplit(".", 1)[-1]
    if actual is None or expected is None:
        return {"==": actual == expected, "!=": actual != expected}.get(op)
    a, b = number(actual), number(expected)
    if a is not None and b is not None:
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return {"==": actual.lower() == expected.lower(), "!=": actual.lower() != expected.lower()}.get(op)


def test_compare(spark):
    rows = [(a, o, r) for a in ACTUAL for o in predicates.OPERATORS for r in RIGHT]
    df = spark.createDataFrame(rows, "a string, o string, r string").select("a", "o", "r", predicates.compare(F.col("a"), F.col("o"), F.col("r")).alias("x"), predicates.compare(F.col("a"), predicates.negate(F.col("o")), F.col("r")).alias("n"))
    for r in df.collect():
        assert r.x == plain(r.a, r.o, r.r), r
        if r.x is not None and r.n is not None and r.o not in ("is_true", "is_false"):
            assert r.x != r.n


def test_constants(spark):
    c = {r.x: r.c for r in spark.createDataFrame([(x,) for x in ("true", '"a"', "5m", "20_000m", "A.B", "a.B", "x", "1,5")], "x string").select("x", predicates.is_constant(F.col("x")).alias("c")).collect()}
    assert c == {"true": True, '"a"': True, "5m": True, "20_000m": False, "A.B": True, "a.B": False, "x": False, "1,5": True}
    o = spark.range(1).select(predicates.opposite(F.lit("a != b")).alias("a"), predicates.opposite(F.lit("f(x)")).alias("b")).first()
    assert (o.a, o.b) == ("a == b", "!(f(x))")


def test_filter_atoms(spark):
    texts = ["Where(o => !o.Done && o.Kind == Kind.A && o.N >= 5)", "Any(x => x.A || x.B)", "Find(x => y.A)", "nothing", "Find(x => x.A)"]
    got = {r.c: r.a and [tuple(x) for x in r.a] for r in spark.createDataFrame([(t,) for t in texts], "c string").select("c", rules.filter_atoms(F.col("c")).alias("a")).collect()}
    assert got == {texts[0]: [("Done", "is_false", None), ("Kind", "==", "Kind.A"), ("N", ">=", "5")], texts[1]: None, texts[2]: None, texts[3]: None, texts[4]: [("A", "is_true", None)]}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    s = F.lit
    r = one(
        spark, short=scalars.short(s("T:A.B`2")), full=scalars.full(s("T:A.B`3")), plain=scalars.full(s("T:A.B")), human=scalars.humanize(s("RequestHTTPPayout2Go")), empty=scalars.humanize(s("")), strip=scalars.strip_suffix(s("Handler"), "Handler"), a=scalars.snake_acronyms(s("HTTPServerName")), b=scalars.snake_simple(s("HTTPServerName")),
        path=scalars.location_path(s("C:/a.cs:12")), none=scalars.location_path(s("a.cs:x")), rel=scalars.relative_path(s("a/b/c.md"), s("a/d/e.md")), same=scalars.relative_path(s("a.md"), s("b.md")), res=scalars.resolve_path(s("a/b/c.md"), s("../x%20y+z.md#f")), out=scalars.resolve_path(s("a/b.md"), s("c.txt")),
        cell=scalars.table_cell(s("a|b\\|c\r\nd")), acc=scalars.accusative(s("Wypłata duża")), lit=scalars.numeric_literal(s("20_000m")), clip=scalars.clip(s("abcdef"), 3), snip=scalars.snippet(s(" a \n\n b ")), link=scalars.code_link(s("x y.cs:3"), "", s("c")),
    )
    assert (r.short, r.full, r.plain, r.human, r.empty, r.strip, r.a, r.b) == ("B", "A.B<,,>", "A.B", "Request httppayout2 go", "", "Handler", "http_server_name", "httpserver_name")
    assert (r.path, r.none, r.rel, r.same, r.res, r.out) == ("C:/a.cs", None, "../d/e.md", "b.md", "a/x y+z.md", None)
    assert (r.cell, r.acc, r.lit, r.clip, r.snip, r.link) == ("a\\|b\\|c d", "wypłatę duża", "20000", "abc…", "a b", "x y.cs:3")


def test_hashes(spark):
    words = ["", "a", "żółw", "hello", "日本"]

    def fnv(w):
        h = 2166136261
        for b in w.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fnv1a(F.col("w")).alias("h"), text.point_id(F.col("w"), F.lit("s")).alias("p"))
    for r in df.collect():
        assert r.h == fnv(r.w)
        assert r.p == str(uuid.uuid5(uuid.UUID(text.NAMESPACE), r.w + "\ns"))


def test_sections(spark):
    pages = {
        "a": "---\nt: 1\n---\n# T\n> note\nintro\n## A\nx\n\n---\n## A (2)\ny\n## A\nz\r\n## Empty\n\n## A\n(notes from `x.md`)\nw\n",
        "b": "---\nnever closed\n## B\n  ok  \n",
        "c": "",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id string, markdown string")
    got = {}
    for r in retrieval.sections(df, "page_id", "markdown").orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.section, r.text))
    assert got["a"] == [("Introduction", "intro"), ("A", "x"), ("A (2)", "y"), ("A (3)", "z"), ("A (4)", "w")]
    assert got["b"] == [("Introduction", "---\nnever closed"), ("B", "ok")] and "c" not in got


@pytest.mark.parametrize("seed", range(3))
def test_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(a, rng.randrange(7)) for a in range(7) for _ in range(2)})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    df = spark.createDataFrame([(a, i, b) for a in out for i, b in enumerate(out[a])], "src int, pos int, dst int")
    order, parents = [], {}

    def visit(x):
        for y in out.get(x, []):
            if y not in parents:
                parents[y] = x
                order.append(y)
                visit(y)

    parents[0] = None
    order.append(0)
    visit(0)
    got = graph.chain(df, spark.createDataFrame([(0,)], "root int")).orderBy("no").collect()
    assert [r.node for r in got] == order and {r.node: r.parent for r in got} == parents
    reach = {r.node: r.depth for r in graph.closure(df, spark.createDataFrame([(0,)], "start int")).collect()}
    assert set(reach) == set(order)
    tree = spark.createDataFrame([(i, None if p is None else p) for i, p in parents.items()] + [(50, 51), (51, 50), (60, 99)], "id int, parent int")
    depth = {r.id: r.depth for r in graph.depths(tree, 20).collect()}
    assert depth[0] == 0 and depth[50] == 20 and depth[60] == 0 and all(depth[i] == depth[p] + 1 for i, p in parents.items() if p is not None)


def test_lookups(spark):
    row = F.lit('{"Status": null, "weight_g": "5"}')
    m = F.from_json(row, "map<string,string>")
    r = one(spark, null=joins.map_value(m, [F.lit("STATUS"), F.lit("weight_g")]), value=joins.map_value(m, [F.lit("x"), F.lit("Weight_G")]), has=joins.map_has(m, [F.lit("status")]), no=joins.map_has(m, [F.lit("y"), F.lit(None).cast("string")]))
    assert (r.null, r.value, r.has, r.no) == (None, "5", True, False)
    handlers = spark.createDataFrame([("m1", ["h"]), ("m2", [])], "message string, guards array<string>")
    validators = spark.createDataFrame([("m1", 2, "b"), ("m1", 1, "a")], "message string, pos int, guards string")
    assert {x.message: x.guards for x in joins.attach_lists(handlers, validators, "message", "guards", "pos").collect()} == {"m1": ["a", "b", "h"], "m2": []}
    many = joins.attach_all(spark.range(2), spark.range(5).withColumnRenamed("id", "x"), 2)  # more than are broadcast at a time
    assert sorted(map(tuple, many.collect())) == [(a, b) for a in range(2) for b in range(5)]
    order = spark.createDataFrame([("\U0001f600",), ("\uffee",)], "x string")
    assert [r.x for r in order.orderBy(scalars.ordinal_key(F.col("x"))).collect()] == ["\U0001f600", "\uffee"] and [r.x for r in order.orderBy("x").collect()] == ["\uffee", "\U0001f600"]


def test_divide(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (3, "a"), (4, None)], "k int, v string")
    assert sorted(r.k for r in joins.divide(pairs, "k", "v", spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")).collect()) == [1, 3]


def test_ordinals(spark):
    n = spark.createDataFrame([(1,), (26,), (27,)], "n int").select(ordinals.node_letter(F.col("n")).alias("x"))
    assert [r.x for r in n.collect()] == ["A", "Z", "N26"]
    runs = ordinals.run_text(ordinals.runs(spark.createDataFrame([(1, x) for x in (1, 4, 5, 6, 7, 7, 9)], "g int, n int"), ["g"], "n"), ["g"])
    assert runs.first().text == "1, 4–7 and 9"


def test_sync(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    merged = sync.merge(table, spark.createDataFrame([("b", 9), ("d", 4)], "id string, v int"), spark.createDataFrame([("a",)], "id string"), "id")
    assert {(r.id, r.v) for r in merged.collect()} == {("b", 9), ("c", 3), ("d", 4)}
    cache = spark.createDataFrame([("h1",), ("h2",)], "card_hash string")
    assert [r.card_hash for r in sync.drop_cached(cache, spark.createDataFrame([("h1", "needs_review"), ("h2", "ok")], "card_hash string, status string")).collect()] == ["h2"]


def test_stream(spark, tmp_path):
    from ledgerloom.streaming import page_index

    source, table = tmp_path / "in", f"{tmp_path}/points"
    source.mkdir()
    run = lambda: page_index.follow(spark, str(source), table, f"{tmp_path}/cp").awaitTermination()
    (source / "1.json").write_text('{"page_id": "p", "markdown": "intro\\n## A\\nx", "version": 1}\n{"page_id": "q", "markdown": "only", "version": 1}\n')
    run()
    (source / "2.json").write_text('{"page_id": "p", "markdown": "intro\\n## B\\ny", "version": 2}\n{"page_id": "q", "markdown": "only", "version": 2}\n')
    run()
    points = spark.read.parquet(table)
    assert points.count() == 5
    assert sorted((r.page_id, r.section) for r in page_index.current(points).collect()) == [("p", "B"), ("p", "Introduction"), ("q", "Introduction")]


def test_rows_are_counted_by_a_bounded_number_of_tokens():
    import pyarrow as pa

    from ledgerloom.operators import retrieval

    lists = [["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 2, ["e"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], ["doc", "tokens"])
    parts = list(retrieval._slices(batch.slice(1), most=4))  # of a batch that begins later
    assert [(at, p.column(0).to_pylist()) for at, p in parts] == [(0, [1, 2]), (2, [3]), (3, [4, 5]), (5, [6])]
    assert [x for _, p in parts for x in p.column(1).to_pylist()] == lists[1:]
    assert retrieval.TOKENS <= 1 << 20
