"""Near duplicates, components and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import near_dedup
from ledgerloom.llm.components import components


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "u bigint, v bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: c for n, c in roots({n for e in edges for n in e}, edges).items() if n != c}
    assert components(df.limit(0)).count() == 0


def words(text, k):
    low = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
    w = (text or "").encode().translate(low).split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, like):
    sets = {i: words(t, like.shingle) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= like.per_cent * len(sets[a] | sets[b])]
    return sets, roots(sets, edges)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(6):  # groups whose members differ from a base by few or many edits
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(150)]
    for i in range(12):  # each only near its neighbours
        chain[i * 12 : i * 12 + 2] = [word(), word()]
        out.append(" ".join(chain))
    out += ["", " \n", None, "one", "One", "one two", "ONE TWO", "one two three", out[0], out[0].upper(), out[0]]
    rng.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("block, like", [(near_dedup.BLOCK, near_dedup.CONTRACT), (3, near_dedup.CONTRACT), (near_dedup.BLOCK, near_dedup.Likeness())])
def test_near_duplicates(spark, rows, monkeypatch, block, like):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets, parts = brute(rows, like)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, rep string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, like).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == parts
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_edges(spark, rows):
    odd = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (9, "A b c D"), (None, "a b c d"), (6, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("6", 6, True), ("9", 5, False), ("None", None, True)]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_follows_the_similarity():
    for like in (near_dedup.CONTRACT, near_dedup.Likeness(), near_dedup.Likeness(4, 95)):
        t = like.per_cent / 100
        assert like.bands * like.rows <= near_dedup.HASHES and (1 - t**like.rows) ** like.bands < near_dedup.MISS
        rng = np.random.default_rng(1)
        assert (rng.binomial(near_dedup.HASHES, t, 100_000) >= like.least_equal).all()
    assert (near_dedup.Likeness().shingle, near_dedup.Likeness().per_cent) == (5, 80)


def test_spanning_links_joins_all_it_can():
    sets = [np.arange(a, a + 200, dtype=np.uint64) for a in (0, 10, 20, 30, 500)]
    sigs = np.stack([near_dedup.minima(s).astype("<u2") for s in sets])
    names = [b"1", b"2", b"3", b"4", b"5"]
    found = near_dedup.spanning_links(names, names, sigs, sets, np.zeros(5))
    assert roots(names, found) == {b"1": b"1", b"2": b"1", b"3": b"1", b"4": b"1", b"5": b"5"}


def test_repeated_ids(spark):
    """Texts of one doc_id are nodes of their own: unlike ones are not linked by it, and none gets lost."""
    t, u = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, t), (2, u), (2, t + " x"), (2, t.upper()), (2, u), (-3, u + " y"), (None, u), (None, u), (4, None), (4, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component", F.lit("clash"))
    got = {(r.doc_id, r.text) for r in near_dedup.without_near_copies(docs).collect()}
    assert {x for x in got if x[1]} == {(1, t), (-3, u + " y"), (None, u)}
    assert len(got) == 5 and near_dedup.without_near_copies(docs).columns == docs.columns  # 4 and 5 have no words
    ids = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs.where("doc_id < 3")).collect())
    assert ids == [(-3, -3), (1, 1), (2, -3), (2, -3), (2, 1), (2, 1)]
    extreme = spark.createDataFrame([(-(1 << 63), t), ((1 << 63) - 1, t), (0, t + " z")], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(extreme).collect()} == {-(1 << 63)}


def test_pipeline_stages(spark, tmp_path):
    line = lambda tag: " ".join(f"{tag}{i}" for i in range(15))
    body = "\n".join(line(f"p{k}x") for k in range(8))
    texts = {1: body, 2: body, 3: "start\n" + body.split("\n", 1)[0] + "\n" + line("own"), 4: line("bench") + "\n" + line("u"), 5: "you are an evilword evilword2 " + line("v"), 6: line("q") * 3, 7: line("q") * 3 + " end", 8: None}
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    toxic = {i: f"evilword evilword2 {line(f't{i}y')}" for i in range(100, 130)}
    clean = {i: line(f"c{i}z") for i in range(200, 260)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in {**texts, **toxic, **clean}.items()]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 200)) for i in [*toxic, *clean]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, line("bench"))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    keep = set(clean)
    assert seen[0] == keep | {1, 2, 3, 4, 6, 7, 8}
    assert seen[1] == keep | {1, 3, 4, 6, 7, 8}  # 2 lost all its lines
    assert seen[2] == keep | {1, 3, 4, 6, 8}
    assert seen[3] == seen[4] == keep | {1, 3, 6, 8}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.select("doc_id").collect()} == seen[4] and whole.agg(F.count("ids_sha256")).first()[0] == len(seen[4])
