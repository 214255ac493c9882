"""Toxicity by a chain of linear classifiers.

The categories have an order. The first is predicted from the words of a text; each
later one also gets the probabilities of those before it. In training these are
out-of-fold predictions (a model never feeds forward what it has seen), so that a
later model meets the kind of errors that it meets in use.

Features are the words of a text and the beginnings of longer ones, hashed to
``2 ** BITS`` numbers; none is left out. A feature's value is how much more often one
class has it than the other (the logarithm of the ratio), as the rows say that a model
is trained on: the rows of the other folds only, where it is to predict a fold. The
probability from which a document counts comes from the out-of-fold predictions, too.

Training uses at most ``SAMPLE`` labelled rows (those with the smallest hashes of doc_id
and text) and at most ``CELLS`` features of them; only their feature numbers reach the
driver. Prediction covers all documents and is narrow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

SAMPLE, CELLS, BITS, FOLDS, BEGINNING = 6000, 20_000_000, 18, 4, 5
RIDGE, STEPS = 1e-3, 80
#: Share of the documents without the last category that may be taken for ones with it, and the least probability that counts.
MAX_FALSE, LEAST = 0.001, 0.4
BLOCK_BYTES = 4_000_000
#: Letters and digits are words, as are all characters beyond ASCII.
_WORDS = runtime.byte_table([*range(48, 58), *range(97, 123)])


def _number(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) >> 64 - BITS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text in ascending order, one text after another, and where each text's begin (and the last end)."""
    word, bounds, names = runtime.words(texts, _WORDS)
    whole = np.array([_number(n) for n in names], np.int64)
    starts = [n.decode("utf-8", "replace")[:BEGINNING] if len(n) > BEGINNING else "" for n in names]
    begun = np.array([_number(s.encode() + b"*") if s and len(s.encode()) < len(n) else -1 for s, n in zip(starts, names)], np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds)) << BITS
    both = np.concatenate([text + whole[word], (text + begun[word])[begun[word] >= 0]]) if len(word) else np.zeros(0, np.int64)
    found = np.unique(both)
    return (found & (1 << BITS) - 1).astype(np.int32), np.searchsorted(found >> BITS, np.arange(len(texts) + 1))


@dataclass
class Rows:
    """Feature numbers of documents, one document after another, and columns of earlier probabilities."""

    at: np.ndarray
    bounds: np.ndarray
    earlier: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[rows]
        ends = np.cumsum(sizes)
        where = np.repeat(self.bounds[:-1][rows] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        return Rows(self.at[where], np.concatenate([[0], ends]), self.earlier[rows])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each document the sum of its features' values."""
        total = np.concatenate([[0], np.cumsum(values[self.at], dtype=np.float64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """A logistic model; without both classes to learn from it always gives the share of ones."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    constant: float | None = None

    def predict(self, x: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(x.sums(self.weights) + x.earlier @ self.earlier + self.bias)


def log_ratios(x: Rows, y: np.ndarray) -> np.ndarray:
    """How much more often (or less, without sign) the one class has each feature; 0 for features that no row has."""
    ones = np.repeat(y, np.diff(x.bounds))
    n = np.bincount(x.at, minlength=1 << BITS)
    has = np.bincount(x.at, weights=ones, minlength=1 << BITS)
    return np.abs(np.log((has + 0.5) / (y.sum() + 1)) - np.log((n - has + 0.5) / (len(y) - y.sum() + 1))) * (n > 0)


def fit_linear(x: Rows, y: np.ndarray) -> Linear:
    """Logistic regression with a ridge and balanced classes, by accelerated gradient steps from zero."""
    n, d = len(x), x.earlier.shape[1]
    if not n or y.min() == y.max():
        return Linear(np.zeros(0), np.zeros(d), 0.0, float(y.mean()) if n else 0.0)
    used, at = np.unique(x.at, return_inverse=True)
    value = log_ratios(x, y)[used]
    m, dense = len(used), np.hstack([x.earlier, np.ones((n, 1))]).astype(np.float32)
    # The cells by row and by column, so that both products are sums of neighbours.
    sizes = np.diff(x.bounds)
    full, starts = np.flatnonzero(sizes), x.bounds[:-1][sizes > 0]
    by_column = np.argsort(at, kind="stable")
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_column]
    columns = np.flatnonzero(np.concatenate([[True], np.diff(at[by_column]) > 0])) if m else np.zeros(0, np.int64)
    at, value = at.astype(np.int32), value.astype(np.float32)

    def times(w: np.ndarray) -> np.ndarray:
        out = dense @ w[m:]
        if m:
            out[full] += np.add.reduceat((w[:m] * value)[at], starts)
        return out

    def back(g: np.ndarray) -> np.ndarray:
        g = g.astype(np.float32)
        return np.concatenate([np.add.reduceat(g[row], columns) * value if m else np.zeros(0, np.float32), dense.T @ g])

    share = np.where(y > 0, 1 / (2 * y.sum()), 1 / (2 * (n - y.sum())))  # both classes weigh the same
    v = np.ones(m + d + 1, np.float32)
    for _ in range(8):  # the largest curvature bounds the step
        v = back(share * times(v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.3 * np.linalg.norm(back(share * times(v))) + RIDGE)
    ridge = np.append(np.full(m + d, RIDGE), 0).astype(np.float32)
    w = z = np.zeros(m + d + 1, np.float32)
    for step in range(STEPS):
        following = z - np.float32(rate) * (back(share * (_sigmoid(times(z)) - y)) + ridge * z)
        z = following + np.float32(step / (step + 3)) * (following - w)
        w = following
    weights = np.zeros(1 << BITS)
    weights[used] = w[:m] * value
    return Linear(weights, w[m:-1].astype(float), float(w[-1]))


@dataclass
class Chain:
    """The models in order, and the probability of the last category from which a document counts as one of it."""

    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def fit(self, x: Rows, labels: np.ndarray) -> Chain:
        fold = np.arange(len(x)) % FOLDS
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            outside = np.zeros(len(x))
            for f in range(FOLDS):
                if (fold == f).any():
                    outside[fold == f] = fit_linear(x.take(np.flatnonzero(fold != f)), y[fold != f]).predict(x.take(np.flatnonzero(fold == f)))
            self.models.append(fit_linear(x, y))
            x = Rows(x.at, x.bounds, np.hstack([x.earlier, outside[:, None]]))
        if len(x) and self.categories:
            false = np.sort(outside[y == 0])[::-1]
            may = int(MAX_FALSE * len(false))
            self.threshold = float(max(LEAST, np.nextafter(false[may], 2))) if may < len(false) else LEAST
        return self

    def predict(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        x = Rows(at, bounds, np.zeros((len(bounds) - 1, 0)))
        for model in self.models:
            x.earlier = np.hstack([x.earlier, model.predict(x)[:, None]])
        return x.earlier


def _sample(documents: DataFrame, labels: DataFrame, categories: Sequence[str], size: int) -> DataFrame:
    """``doc_id``, the categories and ``features`` of at most ``size`` labelled rows to learn from; rows that agree in id and text are one."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    known = known.dropna().groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # at most ``size`` narrow rows, so they can be broadcast
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    # Ids may repeat without bound: of the narrow rows again as many as may be.
    rows = docs.select("doc_id", "version").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(size)
    docs = docs.join(F.broadcast(rows), ["doc_id", "version"])
    names = [f"y{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES):
                found, bounds = features(some)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([runtime.values(part, "doc_id"), runtime.values(part, "version"), *(runtime.values(part, y) for y in names), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found))], ["doc_id", "version", *names, "features"])
                at += len(some)
        runtime.trim()

    return docs.mapInArrow(run, f"doc_id bigint, version bigint, {', '.join(f'{y} int' for y in names)}, features array<int>").dropDuplicates(["doc_id", "version"])


def _bounded(learned: DataFrame) -> DataFrame:
    """The rows in order of their hashes as long as they have at most ``CELLS`` features in all (a very long text may have a quarter of a million)."""
    sizes = learned.select("doc_id", "version", F.size("features").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "version").collect()
    ends = np.cumsum([r.n for r in sizes])
    kept = int(np.searchsorted(ends, CELLS, "right"))
    if kept == len(sizes):
        return learned
    few = learned.sparkSession.createDataFrame([(r.doc_id, r.version) for r in sizes[:kept]], "doc_id bigint, version bigint")
    return learned.join(F.broadcast(few), ["doc_id", "version"])


def train(documents: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """Learn the chain for 0/1 columns ``categories`` of ``labels``, in this order.

    Labels with a null are ignored; of labels that repeat a doc_id the largest count;
    labels without a document, and documents without a label, play no part; rows that
    repeat a labelled doc_id count once for each text, up to ``sample`` rows in all.
    Without any labelled document each probability is 0.
    """
    runtime.ship(documents.sparkSession)
    names = [f"y{i}" for i in range(len(categories))]
    learned = runtime.table(_sample(documents, labels, categories, sample), "toxicity-sample")
    rows = _bounded(learned).orderBy(F.xxhash64("doc_id"), "doc_id", "features").toArrow().combine_chunks()
    lists = rows.column("features").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    x = Rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds, np.zeros((rows.num_rows, 0)))
    return Chain(tuple(categories)).fit(x, np.stack([rows.column(y).to_numpy() for y in names], axis=1))


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """All columns of ``documents`` and ``probabilities``, one for each category in order.

    A null or empty text has no features and gets what the biases say; repeated rows get
    the same; an empty table stays empty. ``documents`` may not have a column
    ``probabilities`` of its own (it is replaced).
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    docs = documents.drop("probabilities").withColumn("text", F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(Chain(chain.categories, [Linear(m.weights.astype(np.float32), m.earlier, m.bias, m.constant) for m in chain.models]))
    schema = docs.select("*", F.array(F.lit(0.0)).alias("probabilities")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.predict(*features(some)) for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES)]
            n = len(model.models)
            flat = np.concatenate(out).reshape(-1) if out else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "probabilities"])
        runtime.trim()

    return docs.mapInArrow(run, schema)
