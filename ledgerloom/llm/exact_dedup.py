"""Exact dedup of batches against immutable snapshots.

Texts are equal when they are identical without ASCII white space. A text is known by
its digest; equal digests are only believed after a comparison of bytes.

``admit`` takes a batch of documents into a snapshot of its own, which never changes
again: the digests of all its rows (``members``), its distinct digests in exact buckets
(``exact``) and a binary-fuse filter for each bucket (``filters``). The digests of the
batch are screened by the filters of the earlier snapshots; those that pass join the
exact buckets, which removes false positives. Digests that several rows of the batch
share are found by grouping the batch alone. Only the texts behind these two kinds of
digests are read again and compared; all other rows need nothing more. ``resolve``
brings the classes of some snapshots together.

A filter (Graf and Lemire, 2022) has nine bits for each digest; a digest that is not in
it passes with a chance of 1/256. It is built for a bucket of about ``BUCKET`` digests,
whatever their number in all, and a task holds some buckets at a time. Hot texts are
pre-aggregated before each shuffle, and classes with over a thousandth of all rows (at
most a thousand of them) are attached by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm import runtime

#: Digests of a bucket, on average.
BUCKET = 1 << 15
#: Filters of up to so many bytes in all are broadcast; beyond that, texts go to their digests by a shuffle.
BROADCAST_BYTES = 64 << 20
#: A class with more than one in so many rows is attached by broadcast: at most so many classes.
HOT = 1000

_FILTER = "bucket int, seed bigint, segment int, segments int, prints binary"
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Fuse:
    """A three-wise binary-fuse filter with 8-bit fingerprints."""

    seed: int
    segment: int
    segments: int
    prints: np.ndarray

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in segments that follow each other, and its fingerprint."""
        h = _mixed(keys, self.seed)
        first = (h >> np.uint64(32)) * np.uint64(self.segments * self.segment) >> np.uint64(32)
        mask, one = np.uint64(self.segment - 1), np.uint64(self.segment)
        second = first + one ^ h >> np.uint64(18) & mask
        third = first + one + one ^ h & mask
        return np.stack([first, second, third]).astype(np.int64), (h ^ h >> np.uint64(32)).astype(np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], np.int64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter: always true for those that are."""
        places, prints = self._places(keys)
        return self.prints[places[0]] ^ self.prints[places[1]] ^ self.prints[places[2]] == prints

    @staticmethod
    def of(keys: np.ndarray) -> Fuse:
        """The filter of some keys; repeated keys count once."""
        keys = np.unique(keys.astype(np.int64))
        n = max(2, len(keys))
        segment = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
        room = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 100):
            empty = Fuse(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if empty._fill(keys):
                return empty
        raise ArithmeticError("no seed gives a filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Give each key a slot that no key before it needs, round by round; false if some keys stay entangled."""
        places, prints = self._places(keys)
        number = np.arange(len(keys), dtype=np.int64)
        count = np.bincount(places.ravel(), minlength=len(self.prints))
        names = np.zeros(len(self.prints), np.int64)  # of the keys in a slot, combined; of a single one, itself
        for row in places:
            np.bitwise_xor.at(names, row, number)
        order: list[tuple[np.ndarray, np.ndarray]] = []
        slots, left = np.flatnonzero(count == 1), len(keys)
        while len(slots):
            peeled, first = np.unique(names[slots], return_index=True)
            order.append((peeled, slots[first]))
            left -= len(peeled)
            touched = places[:, peeled]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(names, row, peeled)
            slots = np.unique(touched)
            slots = slots[count[slots] == 1]
        if left:
            return False
        for peeled, own in reversed(order):
            at = places[:, peeled]
            self.prints[own] = prints[peeled] ^ self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]
        return True


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that each seed deals the keys anew."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(times)
    return h ^ h >> np.uint64(31)


def normalised(text: Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _BLANK, "")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


Digest = Callable[[Column], Column]


def _rows(documents: DataFrame, digest: Digest) -> DataFrame:
    """``doc_id``, ``points`` (code points of the text as it is), ``body`` (normalised) and ``digest``."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("points"), normalised(F.col("text")).alias("body"))
    return rows.withColumn("digest", digest(F.col("body")))


def _keyed(digests: DataFrame, buckets: int) -> DataFrame:
    """Add ``key``, what filters know of a digest, and ``bucket``."""
    return digests.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _buckets(n: int) -> int:
    return max(1, -(-n // BUCKET))


def fuse_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """A filter for each bucket of some distinct digests."""
    runtime.ship(digests.sparkSession)

    def build(group: pa.Table) -> pa.Table:
        f = Fuse.of(group.column("key").to_numpy())
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "seed": [f.seed], "segment": pa.array([f.segment], pa.int32()), "segments": pa.array([f.segments], pa.int32()), "prints": [f.prints.tobytes()]})

    return _keyed(digests, buckets).select("bucket", "key").groupBy("bucket").applyInArrow(build, _FILTER)


def _fuse(row) -> Fuse:
    return Fuse(row["seed"], row["segment"], row["segments"], np.frombuffer(row["prints"], np.uint8))


@dataclass(frozen=True)
class Snapshot:
    """What ``admit`` wrote of a batch to ``folder``; ``documents`` are the batch itself, which must stay as it is, for later comparisons of bytes."""

    documents: DataFrame
    folder: str
    digest: Digest = sha256

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.documents.sparkSession.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def members(self) -> DataFrame:
        """A row for each document: ``doc_id``, ``points``, ``digest`` and ``class``, which is the digest unless another text owns that."""
        return self._read("members", "doc_id bigint, points int, digest binary, class binary")

    @property
    def exact(self) -> DataFrame:
        """The distinct digests, each in its bucket, with the rows that have it."""
        return self._read("exact", "bucket int, digest binary, n bigint")

    @property
    def foreign(self) -> DataFrame:
        """``digest`` and ``body`` of texts whose digest is owned by another text."""
        return self._read("foreign", "digest binary, body string")

    @property
    def filters(self) -> DataFrame:
        return self._read("filters", f"{_FILTER}, buckets int")


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The ``digest`` of those distinct digests that are in the snapshot.

    The filter of each bucket sees the digests of this bucket; what passes joins the
    exact bucket. An empty snapshot has none.
    """
    filters = snapshot.filters
    first = filters.select("buckets").first()
    if first is None:
        return digests.select("digest").limit(0)
    runtime.ship(digests.sparkSession)

    def pass_filter(group: pa.Table, own: pa.Table) -> pa.Table:
        asked = runtime.plain(group.select(["digest", "bucket"]))
        if not own.num_rows or not group.num_rows:
            return asked.slice(0, 0)
        return asked.filter(pa.array(_fuse(own.to_pylist()[0]).maybe(group.column("key").to_numpy())))

    keyed = _keyed(digests.select("digest"), first.buckets).groupBy("bucket")
    maybe = keyed.cogroup(filters.drop("buckets").groupBy("bucket")).applyInArrow(pass_filter, "digest binary, bucket int")
    return maybe.join(snapshot.exact, ["bucket", "digest"], "left_semi").select("digest")


def _of_digests(documents: DataFrame, wanted: DataFrame, digest: Digest, spare: bool = True) -> DataFrame:
    """The rows of documents whose digest is one of some distinct ones; a broadcast filter of these spares the other texts the shuffle."""
    rows, n = _rows(documents, digest), wanted.count()
    if not n:
        return rows.limit(0)
    if spare and 1.3 * n + 4096 <= BROADCAST_BYTES:
        spark, buckets = documents.sparkSession, _buckets(n)
        shared = spark.sparkContext.broadcast({r.bucket: _fuse(r) for r in fuse_filters(wanted, buckets).collect()})

        @pandas_udf("boolean")
        def maybe(bucket: pd.Series, key: pd.Series) -> pd.Series:
            out, of = np.zeros(len(key), bool), bucket.to_numpy()
            for b in np.unique(of):
                if b in shared.value:
                    out[of == b] = shared.value[b].maybe(key.to_numpy()[of == b])
            return pd.Series(out)

        rows = _keyed(rows, buckets).where(maybe("bucket", "key")).drop("key", "bucket")
    return rows.join(wanted, "digest", "left_semi")


def admit(batch: DataFrame, folder: str, earlier: Sequence[Snapshot] = (), digest: Digest = sha256) -> Snapshot:
    """Take a batch (``doc_id``, ``text``) into a new snapshot in ``folder``, compared with earlier ones.

    A null text counts as empty, and empty texts are equal; rows that repeat an id or a
    text are rows of their own; other columns are ignored; an empty batch gives an empty
    snapshot; texts are read whole, whatever their length. Texts with the same digest
    that differ become classes of their own.
    """
    spark = batch.sparkSession
    plain = runtime.table(_rows(batch, digest).select("doc_id", "points", "digest"), "dedup-rows")
    counts = runtime.table(plain.groupBy("digest").agg(F.count("*").alias("n")), "dedup-digests")
    n = counts.count()
    buckets = _buckets(n)
    exact = _keyed(counts, buckets).select("bucket", "digest", "n")
    exact.repartition(F.col("bucket")).sortWithinPartitions("bucket", "digest").write.parquet(f"{folder}/exact")
    fuse_filters(counts, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/filters")

    others = _foreign(batch, counts, earlier, digest)
    others.write.parquet(f"{folder}/foreign")
    members = plain.withColumn("class", F.col("digest"))
    if not others.isEmpty():  # texts that differ under one digest: their rows get their bytes into the class
        rows = _of_digests(batch, others.select("digest").distinct(), digest)
        odd = rows.join(others, ["digest", "body"], "left_semi").select("doc_id", "points", "digest", F.concat("digest", F.encode("body", "utf-8")).alias("class"))
        even = rows.join(others, ["digest", "body"], "left_anti").select("doc_id", "points", "digest", F.col("digest").alias("class"))
        members = members.join(others.select("digest").distinct(), "digest", "left_anti").select("doc_id", "points", "digest", "class").unionByName(odd).unionByName(even)
    members.write.parquet(f"{folder}/members")
    out = Snapshot(batch, folder, digest)
    runtime.drop(spark, plain._shared_path, counts._shared_path)
    return out


def _foreign(batch: DataFrame, counts: DataFrame, earlier: Sequence[Snapshot], digest: Digest) -> DataFrame:
    """``digest`` and ``body`` of texts of the batch whose digest belongs to another text.

    A digest belongs to the text of the earliest snapshot that has it, else to the first
    of the batch in byte order. Copies are combined where they are read.
    """
    own = runtime.table(counts.where("n > 1").select("digest"), "dedup-own")  # grouped by themselves
    owners, known = None, None
    for snapshot in earlier:
        hits = screen(counts, snapshot)
        if known is not None:
            hits = hits.join(known, "digest", "left_anti")
        hits = runtime.table(hits, "dedup-hits")
        bodies = _of_digests(snapshot.documents, hits, digest).groupBy("digest", "body").count().select("digest", "body")
        bodies = bodies.join(snapshot.foreign, ["digest", "body"], "left_anti")
        owners = bodies if owners is None else owners.unionByName(bodies)
        known = hits if known is None else runtime.table(known.unionByName(hits), "dedup-known")
    suspects = own if known is None else runtime.table(own.unionByName(known).distinct(), "dedup-suspects")
    texts = runtime.table(_of_digests(batch, suspects, digest).groupBy("digest", "body").count().select("digest", "body"), "dedup-texts")
    inside = texts if known is None else texts.join(known, "digest", "left_anti")
    first = inside.groupBy("digest").agg(F.min("body").alias("body"))
    owners = first if owners is None else owners.unionByName(first)
    return runtime.table(texts.join(owners, ["digest", "body"], "left_anti"), "dedup-others")


def resolve(snapshots: Sequence[Snapshot]) -> DataFrame:
    """A row for each document of the snapshots: ``doc_id``, ``digest``, ``keep_id``, ``group_size`` and ``kept``.

    Of equal texts the row with the most code points stays, then the one with the
    smallest ``doc_id`` (null comes last); of rows that agree in both, one.
    """
    members = snapshots[0].members
    for s in snapshots[1:]:
        members = members.unionByName(s.members)
    rank = F.struct("points", (-1 - F.col("doc_id")).alias("order"))  # -1 - x orders all of bigint without overflow
    classes = runtime.table(members.groupBy("class").agg(F.count("*").alias("group_size"), F.max(rank).alias("best")), "dedup-classes")
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    # Rows that agree in all are numbered, so that one of them stays.
    rows = members.groupBy("doc_id", "points", "digest", "class").agg(F.count("*").cast("int").alias("times"))
    often = F.col("group_size") * HOT > total
    hot, rest = F.broadcast(classes.where(often)), classes.where(~often)
    joined = rows.join(hot, "class").unionByName(rows.join(hot, "class", "left_anti").join(rest, "class"))
    keep = (-1 - F.col("best.order")).alias("keep_id")
    first = (F.col("points") == F.col("best.points")) & F.col("doc_id").eqNullSafe(-1 - F.col("best.order"))
    return joined.select("doc_id", "digest", keep, "group_size", first.alias("first"), F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("doc_id", "digest", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"))


def dedup(documents: DataFrame, generations: int = 2, digest: Digest = sha256) -> DataFrame:
    """``resolve`` after taking documents in by generations (by a hash of ``doc_id``), each compared with those before it."""
    spark: SparkSession = documents.sparkSession
    of = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(generations))
    snapshots: list[Snapshot] = []
    for g in range(generations):
        snapshots.append(admit(documents.where(of == g), runtime.shared_path(spark, "dedup-snapshot"), snapshots, digest))
    return resolve(snapshots)
