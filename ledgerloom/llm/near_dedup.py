"""Near-duplicate documents: MinHash with banding, verification, components.

What is near is a ``Likeness``: the words of a shingle and the least similarity of two
sets. Bands and the floor of the signature check follow from the similarity.

1. One pass over the texts makes each document's set of shingles (64-bit hashes), its
   fingerprint, and ``HASHES`` universal hash minima, kept as a hash for each band.
   Documents with equal sets are one class from here on, named by
   its smallest doc_id and its fingerprint, so groups of copies of any size are one row.
2. Classes that share a band hash are a bucket. No pairs of a bucket are made: each
   class is first linked to the smallest class of its buckets, by checking signatures
   and then the full sets, and the components of these links are found.
3. Only buckets that still hold several components are searched further: a task
   compares signatures of a bucket's classes (large buckets: of two of its blocks at a
   time) and checks on the full sets those that could link two components, until these
   are one. This is exact for all pairs of a bucket and emits at most a spanning tree.
4. Large-star / small-star joins the links.

At the least similarity a pair shares no bucket with a chance below ``MISS``, and fails
the signature check with one below ``FAIL``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime
from ledgerloom.llm.components import components

HASHES = 192
MISS, FAIL = 3e-7, 1e-8
#: Classes of a bucket that one task compares with each other; larger buckets are cut.
BLOCK = 512
#: Bytes of the sets of such a part, as far as single sets allow.
SET_BYTES = 64_000_000
#: Bytes of text that are hashed together.
BLOCK_BYTES = 4_000_000

_LOWER = runtime.byte_table()
_rng = np.random.default_rng(20240611)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
_BAND = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``shingle`` words, of which two sets must share ``per_cent`` of their union."""

    shingle: int = 5
    per_cent: int = 80

    @cached_property
    def rows(self) -> int:
        """The most minima in a band with which a pair of the least similarity still finds a common one."""
        t = self.per_cent / 100
        return max([r for r in range(1, HASHES + 1) if (1 - t**r) ** (HASHES // r) < MISS], default=1)

    @cached_property
    def bands(self) -> int:
        return HASHES // self.rows

    @cached_property
    def least_equal(self) -> int:
        """Equal minima (of their low 16 bits) that a pair must have to be checked on its sets."""
        t, fewer, k = self.per_cent / 100, 0.0, 0
        while k < HASHES and (fewer := fewer + math.comb(HASHES, k) * t**k * (1 - t) ** (HASHES - k)) < FAIL:
            k += 1
        return k

    @cached_property
    def places(self) -> np.ndarray:
        """A multiplier for each word of a shingle."""
        return np.random.default_rng(self.shingle).integers(1, 1 << 63, self.shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: What the query takes, by its contract.
CONTRACT = Likeness(3, 85)


def shingle_sets(texts: pa.Array, like: Likeness = CONTRACT) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; fewer words than a shingle has are one."""
    places, k = like.places, like.shingle
    for some in runtime.slices(texts, BLOCK_BYTES):  # so that little is held beside them
        word, bounds, names = runtime.words(some, _LOWER)
        h = np.array(list(map(xxhash.xxh3_64_intdigest, names)), np.uint64)[word] if names else np.zeros(0, np.uint64)
        x = h[:0]
        if (m := len(h) - k + 1) > 0:
            x = h[:m] * places[0]
            for i in range(1, k):
                x += h[i : i + m] * places[i]
            x = _mixed(x)
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = last - first
            if n >= k:
                yield np.unique(x[first : last - k + 1])
            else:
                yield _mixed(np.array([(h[first:last] * places[:n]).sum() + np.uint64(n)], np.uint64)) if n else h[:0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _MIX
    x ^= x >> np.uint64(33)
    return x


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that is not empty."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 1024):
        x = _A[:, None] * shingles[None, i : i + 1024]
        x += _B[:, None]
        x >>= np.uint64(32)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_hashes(mins: np.ndarray, like: Likeness = CONTRACT) -> np.ndarray:
    n = like.bands * like.rows
    x = (mins[:n] * _BAND[:n]).reshape(like.bands, like.rows).sum(axis=1)
    x ^= x >> np.uint64(29)
    x = x * _MIX + np.arange(like.bands, dtype=np.uint64)
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """``(doc_id, version, n_shingles, fp, bands)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 2000):
                part = batch.slice(some, 2000)
                n, prints, bands = [], [], []
                for s in shingle_sets(runtime.values(part, "text"), like):
                    n.append(len(s))
                    prints.append(fingerprint(s))
                    bands.append(band_hashes(minima(s), like) if len(s) else np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([runtime.values(part, "doc_id"), runtime.values(part, "version"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists], ["doc_id", "version", "n_shingles", "fp", "bands"])
        runtime.trim()

    return docs.mapInArrow(run, "doc_id bigint, version bigint, n_shingles bigint, fp binary, bands array<bigint>")


def _name(doc_id: str, fp: str) -> Column:
    """A class as bytes that sort by doc_id and then by fingerprint."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), 63))), 16, "0")), F.col(fp))


def _doc_id(name: str) -> Column:
    """The doc_id of a class."""
    return (F.conv(F.hex(F.substring(name, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(Decimal(1 << 63))).cast("bigint")


def _profiles(docs: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """``(rep, sig, shingles)`` of the wanted classes ``(rep, doc_id, version)``, from a text of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 500):
                part = batch.slice(some, 500)
                sigs, sets = [], []
                for s in shingle_sets(runtime.values(part, "text"), like):
                    sigs.append(minima(s).astype("<u2").tobytes())
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([runtime.values(part, "rep"), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["rep", "sig", "shingles"])
        runtime.trim()

    one = docs.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])  # rows may be repeated
    return one.select("rep", "text").mapInArrow(run, "rep binary, sig binary, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sets are similar enough, from their sizes and then their members."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < per_cent * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= per_cent * (len(a) + len(b) - shared)


def _verify(pairs: DataFrame, profiles: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``(u, v)`` that are links."""
    p = profiles.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u"), F.col("shingles").alias("set_u"))
    q = profiles.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v"), F.col("shingles").alias("set_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(runtime.values(batch, c).to_pylist() for c in ("sig_u", "sig_v", "set_u", "set_v"))):
                equal = (np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).sum()
                keep.append(bool(equal >= like.least_equal) and linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), like.per_cent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        runtime.trim()

    return pairs.join(p, "u").join(q, "v").select("u", "v", "sig_u", "sig_v", "set_u", "set_v").mapInArrow(run, "u binary, v binary")


class _Union:
    def __init__(self) -> None:
        self.parent: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: bytes, b: bytes) -> None:
        self.parent[max(a, b)] = min(a, b)


def spanning_links(reps: list[bytes], parts: list[bytes], sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, like: Likeness = CONTRACT) -> list[tuple[bytes, bytes]]:
    """Links that join all components a bucket's links can join. ``side``: only pairs of different sides, if there are two."""
    union, out = _Union(), []
    two = len(set(side.tolist())) > 1
    for i in range(len(reps) - 1):
        equal = (sigs[i + 1 :] == sigs[i]).sum(axis=1) >= like.least_equal
        if two:
            equal &= side[i + 1 :] != side[i]
        for j in (np.flatnonzero(equal) + i + 1).tolist():
            a, b = union.find(parts[i]), union.find(parts[j])
            if a != b and linked(sets[i], sets[j], like.per_cent):
                union.join(a, b)
                out.append((reps[i], reps[j]))
    return out


def _search(rows: DataFrame, like: Likeness) -> DataFrame:
    """Links between components of buckets; rows: ``h, n, bytes, rep, part, sig, shingles``.

    A task gets two parts of a bucket, of about ``BLOCK`` rows or ``SET_BYTES`` each.
    """
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / SET_BYTES), F.lit(1)).cast("int")
    cut = rows.withColumn("cuts", cuts).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, F.col("side")).alias("i"), F.greatest(k, F.col("side")).alias("j")))
    dealt = cut.select("h", "rep", "part", "sig", "shingles", "side", F.explode(tasks).alias("t")).select("h", "t.i", "t.j", "rep", "part", "sig", "shingles", "side")

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_pylist()
        sigs = np.frombuffer(b"".join(get("sig")), "<u2").reshape(-1, HASHES)
        found = spanning_links(get("rep"), get("part"), sigs, [np.frombuffer(x, np.uint64) for x in get("shingles")], np.array(get("side")), like)
        return pa.table({"u": pa.array([a for a, _ in found], pa.binary()), "v": pa.array([b for _, b in found], pa.binary())})

    return dealt.groupBy("h", "i", "j").applyInArrow(run, "u binary, v binary")


def grouped(documents: DataFrame, like: Likeness) -> DataFrame:
    """``(doc_id, version, n_shingles, component)`` of each input row.

    ``version``: a hash of the text; ``component``: the least class of the row's
    component, as ``_name`` writes it, null for rows without shingles or doc_id. A class
    is a doc_id and a set, so rows that repeat a doc_id with other texts are not linked by that.
    """
    runtime.ship(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    sketches = runtime.table(_sketches(docs, like), "sketches")
    real = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("fp").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles")).select("fp", "first.*", "bands", "n_shingles")
    classes = runtime.table(classes.withColumn("rep", _name("doc_id", "fp")), "classes")
    bands = classes.select("rep", F.explode("bands").alias("h"))
    buckets = bands.groupBy("h").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = runtime.table(bands.join(buckets, "h").select("h", "n", "rep", "pivot"), "members")
    wanted = classes.select("rep", "doc_id", "version").join(members.select("rep").distinct(), "rep", "left_semi")
    profiles = runtime.table(_profiles(docs, wanted, like), "profiles")
    nearest = members.where("rep <> pivot").groupBy(F.col("rep").alias("u")).agg(F.min("pivot").alias("v"))
    links = runtime.table(_verify(nearest, profiles, like), "links")
    parts = components(links)

    placed = members.join(parts, members.rep == parts.node, "left").select("h", "n", "rep", F.coalesce("component", "rep").alias("part"))
    placed = runtime.table(placed, "placed")
    mixed = placed.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("h")
    # A set has as many bytes as 8 times its shingles, whose number is known without reading it.
    sizes = placed.join(mixed, "h").join(classes.select("rep", "n_shingles"), "rep").groupBy("h").agg((8 * F.sum("n_shingles")).alias("bytes"))
    rows = placed.join(sizes, "h").join(profiles, "rep").select("h", "n", "bytes", "rep", "part", "sig", "shingles")
    more = runtime.table(_search(rows, like), "links")
    joined = components(links.unionByName(more))

    named = classes.join(joined, classes.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return sketches.join(named, "fp", "left").select("doc_id", "version", "n_shingles", F.when(in_class, F.col("component")).alias("component"))


def near_duplicates(documents: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Components of documents whose shingle sets are alike.

    Returns ``doc_id, n_shingles, component_id, kept``, a row for each input row. Null,
    empty and blank texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id get the component of their own texts each, and ``kept`` tells
    whether the doc_id names the component. A null doc_id is in no component and kept.
    Other columns are ignored; an empty table stays empty.
    """
    component_id = F.coalesce(_doc_id("component"), F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component_id, F.lit(True))
    return grouped(documents, like).select("doc_id", "n_shingles", component_id.alias("component_id"), kept.alias("kept"))


def without_near_copies(documents: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each component, of those with its smallest doc_id, and one of each group of rows without shingles or doc_id that agree in doc_id and text.

    All columns stay, whatever their names. Each row's text travels once.
    """
    rows = grouped(documents, like)
    named = rows.where(F.col("doc_id") == _doc_id("component")).groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("one")).select("one.*")
    rest = rows.where("component IS NULL").select("doc_id", "version").distinct()
    # A null doc_id is a value here.
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    kept = named.unionByName(rest).select(*key, "version")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.struct("*").alias("row"), *key, F.xxhash64(text).alias("version"))
    names = ["id", "none", "version"]
    return docs.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")
