"""A stored index of vectors: inverted lists, residual codes, exact re-ranking.

Vectors are made of length 1, so the inner product is the cosine. Centroids are learned
by k-means on a bounded sample (``SAMPLE`` vectors by the hash of their id); every vector
goes to the list of its nearest centroid. What is left of it beside the centroid is cut
into parts, and each part is named by the nearest of 256 learned patterns: a byte each.

The table is partitioned by list. A search reads the lists whose centroids are nearest to
the queries, adds up table values for the bytes of the codes, keeps some candidates of each
query in each batch, and ranks these by their vectors where they were read: candidates are
not shuffled, only the best k of each task. How many lists are read is learned, too: so many
that of the sample's own neighbours ``COVERED`` lie in them. ``exact=True`` compares the
vectors of all lists instead.

A list may hold far more vectors than others (copies): it is written in files of about
``FILE_ROWS`` rows, and readers split it further.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval

#: Vectors to learn from, dimensions of a part, patterns of a part, rounds of learning, rows of a file.
SAMPLE, PART, PATTERNS, ROUNDS, FILE_ROWS = 50_000, 2, 256, 15, 1_000_000
#: Vectors of the sample whose neighbours are looked at, how many of each, and the share that the probed lists should hold.
ASKED, NEIGHBOURS, COVERED = 200, 20, 0.99
#: Lists are at most this many, so that centroids stay small.
MOST_LISTS = 1 << 14


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the nearest center of each row, some rows at a time."""
    half = (centers * centers).sum(axis=1) / 2
    step = max(1, (1 << 24) // max(1, len(centers)))
    return np.concatenate([(x[i : i + step] @ centers.T - half).argmax(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most k centers; a center that loses all its rows takes a row that is far from its own."""
    r = np.random.default_rng(seed)
    centers = np.unique(x, axis=0)
    if len(centers) <= k:
        return centers
    centers = centers[r.choice(len(centers), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            far = np.argsort(-((x - centers[at]) ** 2).sum(axis=1), kind="stable")[: len(lost)]
            centers[lost[: len(far)]] = x[far]
    return centers


@dataclass(frozen=True)
class VectorIndex:
    """What lies in ``folder``; the model is bounded and in memory."""

    spark: SparkSession
    folder: str
    centers: np.ndarray
    patterns: list[np.ndarray]
    #: Lists that a search reads for a query if it is not told otherwise.
    probes: int

    @property
    def table(self) -> DataFrame:
        """``id, code, vector, list``."""
        return self.spark.read.parquet(f"{self.folder}/vectors")


def _codes(rest: np.ndarray, patterns: list[np.ndarray]) -> np.ndarray:
    return np.stack([_nearest(rest[:, i * PART : (i + 1) * PART], p) for i, p in enumerate(patterns)], axis=1).astype(np.uint8) if patterns else np.zeros((len(rest), 0), np.uint8)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _probes(x: np.ndarray, centers: np.ndarray) -> int:
    """How many of the nearest lists hold ``COVERED`` of the neighbours that vectors of the sample have in it."""
    if len(x) < 2:
        return 1
    q = x[: min(ASKED, len(x))]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(NEIGHBOURS, len(x) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(q @ centers.T - (centers * centers).sum(axis=1) / 2), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list among those of a query
    needed = np.take_along_axis(place, _nearest(x, centers)[near], axis=1)
    return int(np.quantile(needed, COVERED, method="higher")) + 1


def build(vectors: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Learn, code and write ``id, vector`` (arrays of one length; null vectors are left out, zero vectors stay).

    ``lists``: about the square root of the number of vectors if not given. Every vector is
    in the index, whatever the sample.
    """
    spark = vectors.sparkSession
    real = vectors.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = real.count()
    # The least hashes lie among twice as many that are expected below a bound: so few rows are sent to be ordered.
    low = real.where(F.xxhash64("id") < -(1 << 63) + (1 << 64) * 2 * sample // n) if n > 4 * sample else real
    seen = low.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column(0)
    dims = len(seen[0].as_py()) if len(seen) else 0
    x = _unit(_matrix(seen.combine_chunks(), dims)) if dims else np.zeros((0, 0))
    k = min(MOST_LISTS, lists or max(1, int(np.sqrt(n))))
    centers = kmeans(x, k) if dims else x
    rest = x - centers[_nearest(x, centers)] if dims else x
    patterns = [kmeans(rest[:, i : i + PART], PATTERNS) for i in range(0, dims, PART)]
    probes = _probes(x, centers)
    kind = real.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            own = _unit(_matrix(batch.column(1), dims))
            at = _nearest(own, centers)
            code = _codes(own - centers[at], patterns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1), pa.array(at, pa.int32())], ["id", "code", "vector", "list"])

    placed = real.mapInArrow(place, f"id {kind}, code binary, vector array<double>, list int")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))  # a row for each list
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("list", "file").select("id", "code", "vector", "list").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{folder}/vectors")
    model = [(i, c.tolist()) for i, c in enumerate(centers)]
    spark.createDataFrame(model, "list int, center array<double>").write.parquet(f"{folder}/centers")
    words = [(i, j, w.tolist()) for i, p in enumerate(patterns) for j, w in enumerate(p)]
    spark.createDataFrame(words, "part int, word int, pattern array<double>").write.parquet(f"{folder}/patterns")
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{folder}/probes")
    return VectorIndex(spark, folder, centers, patterns, probes)


def load(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that ``build`` wrote."""
    centers = np.array([r.center for r in spark.read.parquet(f"{folder}/centers").orderBy("list").collect()], np.float64)
    words = spark.read.parquet(f"{folder}/patterns").orderBy("part", "word").collect()
    patterns = [np.array([r.pattern for r in words if r.part == i], np.float64) for i in range(1 + max((r.part for r in words), default=-1))]
    return VectorIndex(spark, folder, centers, patterns, spark.read.parquet(f"{folder}/probes").first().probes)


def search(index: VectorIndex, queries: DataFrame, k: int, exact: bool = False, probes: int | None = None, candidates: int = 8, digits: int = 9) -> DataFrame:
    """``query, id, score, rank``: the best k vectors of each of ``query, vector`` by cosine; ties by id.

    ``probes`` lists (as many as the index has learned if not given) are read for each
    query, and at least ``candidates`` x k vectors of these ranked exactly (so many of each
    batch that a task reads); ``exact`` ranks all vectors. Queries are taken in blocks of
    bounded size.
    """
    queries = queries.where(F.col("vector").isNotNull()).select("query", F.col("vector").cast("array<double>").alias("vector"))
    if not len(index.centers):
        kinds = queries.schema["query"].dataType.simpleString()
        return index.spark.createDataFrame([], f"query {kinds}, id string, score double, rank int")
    if exact:
        return retrieval.dense_best(index.table.select("id", "vector"), "id", "vector", queries.withColumnRenamed("vector", "wanted"), "query", "wanted", k, digits)
    dims, centers, patterns = index.centers.shape[1], index.centers, index.patterns
    parts = []
    for block in retrieval._blocks(queries, "query"):
        rows = block.toArrow()
        ids = rows.column(0).combine_chunks()
        q = _unit(_matrix(rows.column(1).combine_chunks(), dims))
        near = q @ centers.T - (centers * centers).sum(axis=1) / 2
        probed = np.argsort(-near, axis=1, kind="stable")[:, : probes or index.probes]
        asks = np.zeros((len(centers), len(q)), bool)  # who asks for a list
        asks[probed.ravel(), np.repeat(np.arange(len(q)), probed.shape[1])] = True
        wanted = np.flatnonzero(asks.any(axis=1)).tolist()
        own = index.table.where(F.col("list").isin(wanted)).select("id", "list", "code", "vector")  # other partitions are not listed
        parts.append(retrieval._best(own, "id", ids, "query", _Scores(q, asks, centers, patterns, candidates * k), k, digits))
    return retrieval.ranked(retrieval._union(parts), "query", "id", k, digits)


class _Scores:
    """Of a batch of ``id, list, code, vector`` the cosines of the ``most`` rows of each query that are best by their codes; NaN for others."""

    def __init__(self, q: np.ndarray, asks: np.ndarray, centers: np.ndarray, patterns: list[np.ndarray], most: int) -> None:
        self.q, self.asks, self.centers, self.patterns, self.most = q, asks, centers, patterns, most
        self.tables: list[np.ndarray] | None = None  # of each part: queries x patterns; made where it is used

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.tables is None:
            self.tables = [self.q[:, i * PART : (i + 1) * PART] @ p.T for i, p in enumerate(self.patterns)]
        at = batch.column(1).to_numpy()
        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, len(self.tables))
        rough = np.full((batch.num_rows, len(self.q)), np.nan)
        for one in np.unique(at):
            rows, who = np.flatnonzero(at == one), np.flatnonzero(self.asks[one])
            if len(who):
                total = np.repeat((self.q[who] @ self.centers[one])[None, :], len(rows), axis=0)
                for i, t in enumerate(self.tables):
                    total += t[who][:, code[rows, i]].T
                rough[np.ix_(rows, who)] = total
        unit = _unit(_matrix(batch.column(3), self.q.shape[1]))
        out = np.full(rough.shape, np.nan)
        for j in range(len(self.q)):
            some = np.flatnonzero(~np.isnan(rough[:, j]))
            if len(some) > self.most:
                some = some[np.argpartition(-rough[some, j], self.most - 1)[: self.most]]
            out[some, j] = unit[some] @ self.q[j]
        return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query, wanted, hits``: how many of the exact hits (``query, id``) were found."""
    hit = found.select("query", "id").withColumn("hit", F.lit(1))
    return exact.select("query", "id").join(hit, ["query", "id"], "left").groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
