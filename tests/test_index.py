"""Stored indexes of texts and vectors against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, sparse_index, vector_index

DOCS = "doc bigint, hash string, tokens array<string>"


def best(docs, queries, k):
    n = len(docs)
    df = collections.Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = set()
    for q, tokens in queries.items():
        asked = collections.Counter(tokens)
        scores = [(round(sum(c * d.count(t) * idf[t] for t, c in asked.items() if t in idf), 6), i) for i, d in docs.items() if set(d) & set(asked)]
        for rank, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.add((q, i, rank))
    return out


def test_sparse_index_follows_its_documents(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda: r.choices(words, weights, k=r.choice([0, 3, 20, 20, 400 if r.random() < 0.05 else 30]))
    docs = {i: text() for i in range(900)}
    docs |= {1000 + i: docs[5] for i in range(100)}  # copies, so ties
    queries = {q: r.choices(words, weights, k=6) for q in range(8)} | {90: ["w250"], 91: ["unknown"], 92: words[200:260]}
    asked = spark.createDataFrame([(q, t, n) for q, ts in queries.items() for t, n in collections.Counter(ts).items()], "query int, token string, tf bigint")
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "t"))
    assert sparse_index.search(index, asked, 5).hits.count() == 0

    def bring(now):
        return sparse_index.update(index, spark.createDataFrame([(i, str(hash(tuple(d))), d) for i, d in now.items()], DOCS).repartition(3))

    def check(now, k):
        found = sparse_index.search(index, asked, k, 6)
        assert {(x["query"], x.doc, x["rank"]) for x in found.hits.collect()} == best(now, queries, k)
        return {x["query"]: (x.blocks, x.scored) for x in found.work.collect()}

    assert bring(docs) == {"written": 1000, "dead_blocks": 0}
    work = check(docs, 7)
    assert 91 not in work and sum(s for _, s in work.values()) < 0.6 * sum(b for b, _ in work.values())
    assert bring(docs) == {"written": 0, "dead_blocks": 0}
    fewer = {i: (d if i % 50 else text()) for i, d in docs.items() if i % 97} | {5000 + i: text() for i in range(30)}
    done = bring(fewer)
    assert 30 < done["written"] < len(fewer) + 1 and done["dead_blocks"]
    check(fewer, 7)
    check(fewer, 2000)  # more than there are
    few = {i: d for i, d in fewer.items() if i < 40}
    bring(few)
    check(few, 3)
    with pytest.raises(ValueError):
        sparse_index.update(index, spark.createDataFrame([(1, "h", ["a"]), (1, "i", ["b"])], DOCS))
    bring({})
    assert sparse_index.search(index, asked, 5).hits.count() == 0


def test_an_update_that_dies_changes_nothing(spark, monkeypatch):
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "t"))
    docs = lambda word: spark.createDataFrame([(i, word, [word]) for i in range(5)], DOCS)
    sparse_index.update(index, docs("a"))
    asked = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "query int, token string, tf bigint")
    hits = lambda: {x["query"] for x in sparse_index.search(index, asked, 9).hits.collect()}
    with monkeypatch.context() as m:
        m.setattr(sparse_index.files, "put", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sparse_index.update(index, docs("b"))
    assert hits() == {1}
    sparse_index.update(index, docs("b"))
    assert hits() == {2}


def test_an_update_lays_postings_by_block(spark):
    """A row for each block, made where the block is read (before: a row for each token and block, shuffled three times); a segment without live blocks is read no more."""
    docs = {i: [f"w{i % 7}", "all", "all"] for i in range(130)}
    rows = lambda now, mark: spark.createDataFrame([(i, f"{mark}{d}", d) for i, d in now.items()], DOCS).coalesce(1)
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "t"))
    sparse_index.update(index, rows(docs, "a"))
    assert [(x.n, len(x.tokens), x.places) for x in index.postings.where("block % 64 = 2").select(F.element_at("n", 1).alias("n"), "tokens", "places").collect()] == [(2, 3, [0, 1, 0, 1])]
    assert index.postings.count() == 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # blocks come as several rows
    queries = {1: ["w3", "all"], 2: ["w5"], 3: ["none"]}
    asked = spark.createDataFrame([(q, t, 1) for q, ts in queries.items() for t in ts], "query int, token string, tf bigint")
    changed = {i: [None, *d] for i, d in docs.items() if i != 3}
    done = sparse_index.update(index, rows(changed, "b"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert done == {"written": 129, "dead_blocks": 3}
    assert index._state() == {"segments": [2], "dead": [], "last": 2} and index.postings.count() > 3
    found = sparse_index.search(index, asked, 9, 6).hits.collect()
    assert {(x["query"], x.doc, x["rank"]) for x in found} == best({i: d[1:] for i, d in changed.items()}, queries, 9)


def test_a_search_scores_in_the_task_that_reads(spark, monkeypatch):
    """Scores are not summed over a shuffle (before: a row for each query, token and document); more queries than a block are read for in turns."""
    monkeypatch.setattr(sparse_index.retrieval, "QUERY_BLOCK", 2)
    docs = {i: [f"w{i % 7}", f"v{i % 11}", *["all"] * (i % 3)] for i in range(300)}
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "t"))
    sparse_index.update(index, spark.createDataFrame([(i, "a", d) for i, d in docs.items()], DOCS))
    queries = {f"q{i}": [f"w{i}", f"v{i}", "all"] for i in range(5)}
    asked = spark.createDataFrame([(q, t, 1) for q, ts in queries.items() for t in ts], "query string, token string, tf bigint")
    found = sparse_index.search(index, asked, 4, 6)
    assert "Aggregate" not in found.hits._jdf.queryExecution().optimizedPlan().toString()
    assert {(x["query"], x.doc, x["rank"]) for x in found.hits.collect()} == best(docs, queries, 4)


def test_a_search_reads_rows_once_and_joins_nothing(spark, monkeypatch):
    """Hits come with their documents from the task that scores (before: joined with a table that held all tokens again); copies are ties, tasks keep few of them."""
    monkeypatch.setattr(sparse_index, "_HITS", 50)
    docs = {i: [f"w{i % 7}", *["all"] * (1 + i % 3)] for i in range(400)} | {1000 + i: ["all"] * 3 for i in range(300)} | {2000: [], 2001: None}
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "t"))
    sparse_index.update(index, spark.createDataFrame([(i, "a", d) for i, d in docs.items()], DOCS).repartition(3))
    assert index.docs.columns == ["block", "doc", "hash"] and index.docs.count() == 702
    assert index.postings.where("longest").count() == 3
    queries = {1: ["all"], 2: ["w3", "all"], 3: ["none"]}
    asked = spark.createDataFrame([(q, t, 1) for q, ts in queries.items() for t in ts], "query int, token string, tf bigint")
    found = sparse_index.search(index, asked, 4, 6)
    plan = found.hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {(x["query"], x.doc, x["rank"]) for x in found.hits.collect()} == best({i: d or [] for i, d in docs.items()}, queries, 4)


def test_vector_index(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    r = np.random.default_rng(4)
    middle = r.normal(size=(30, 24))
    x = np.concatenate([middle[r.integers(0, 30, 2000)] + 0.6 * r.normal(size=(2000, 24)), np.tile(middle[0], (700, 1)), np.zeros((3, 24))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>")
    queries = vectors.where("id % 50 = 0").withColumnRenamed("id", "query")
    folder = graph.shared_folder(spark, "t")
    index = vector_index.build(vectors, folder, sample=1500)
    assert index.table.count() == 2703 and len(index.table.inputFiles()) > len(index.centers)
    exact = vector_index.search(index, queries, 10, exact=True, digits=6)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q, ids in exact.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("h")).collect():
        s = np.round(unit @ unit[q], 6)
        assert [h.id for h in ids] == sorted(range(len(x)), key=lambda i: (-s[i], i))[:10]
    again = vector_index.load(spark, folder)
    found = vector_index.search(again, queries, 10, digits=6).cache()
    assert found.count() == exact.count() and again.probes == index.probes <= len(index.centers)
    n = vector_index.recall(found, exact).agg(F.sum("hits"), F.sum("wanted")).first()
    assert n[0] / n[1] >= 0.95
    few = vector_index.search(index, queries, 10, probes=1, candidates=1, digits=6)
    assert few.groupBy("query").count().agg(F.max("count")).first()[0] <= 10
    nothing = vector_index.build(vectors.limit(0), graph.shared_folder(spark, "t"))
    assert vector_index.search(nothing, queries, 3).count() == 0 and nothing.centers.shape[0] == 0


def test_candidates_of_a_vector_search_are_not_shuffled(spark):
    """They are ranked by their vectors in the task that reads them; joined with vectors and queries they grew beyond a task."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    index = vector_index.build(vectors, graph.shared_folder(spark, "t"), sample=500)
    found = vector_index.search(index, vectors.where("id < 40").withColumnRenamed("id", "query"), 5, probes=len(index.centers), candidates=20)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(h["query"], h["rank"]): h.id for h in found.collect()}
    assert np.mean([got[q, n + 1] == i for q in range(40) for n, i in enumerate(np.argsort(-(unit @ unit[q]))[:5])]) > 0.95


def test_kmeans_uses_all_centers():
    x = np.concatenate([np.zeros((500, 2)), np.arange(40.0).reshape(20, 2)])
    centers = vector_index.kmeans(x, 8)
    assert len(centers) == 8 and len(np.unique(vector_index._nearest(x, centers))) >= 6
    assert len(vector_index.kmeans(np.zeros((9, 2)), 4)) == 1
