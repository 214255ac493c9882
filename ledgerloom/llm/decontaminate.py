"""Benchmark decontamination: a prefix-filtered set join of benchmark windows and documents.

A window (13 consecutive words of an item; all words of a shorter one) occurs in a
document only if each of its three-word shingles does. Shingles are ordered by
rarity: the number of documents that have them, counted over all documents. For full
containment the necessary prefix of that order is one shingle, the rarest, so only
it is joined; a window whose rarest shingle no document has goes at once.

1. The benchmark's windows and shingles become tables. Documents are read once to count
   the shingles of the benchmark in them.
2. Documents are read a second time. Each of their shingles that is a prefix becomes a
   candidate with its place and the words around it.
3. Candidates and windows are joined by the prefix shingle. Its place fixes where the
   window would lie (positional bound) and whether it fits into the text (length
   bound); then all its words are compared. Only hits are gathered by document.

Both readings look shingles up in a Bloom filter of at most ``BLOOM_WORDS`` 64-bit words,
so what is broadcast is bounded for a benchmark of any size; false hits of the filter
fall out of the joins. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

WINDOW, SHINGLE = 13, 3
#: 64-bit words of a filter at most (8 MB), and bits for each shingle up to there.
BLOOM_WORDS, BLOOM_BITS = 1 << 20, 16
BLOCK_BYTES = 4_000_000

#: Letters and digits are words, as are all characters beyond ASCII.
_WORDS = runtime.byte_table([*range(48, 58), *range(97, 123)])
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: bytes) -> list[bytes]:
    """The words of one text."""
    return bytes(_WORDS[np.frombuffer(text, np.uint8)]).split()


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, names)), np.uint64)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words, given the hashes of the words."""
    n = max(0, len(h) - size + 1)
    x = np.full(n, size, np.uint64)
    for k in range(size):
        x += h[k : k + n] * _PLACE[k]
    x ^= x >> np.uint64(33)
    x *= _MIX
    x ^= x >> np.uint64(33)
    return x.view(np.int64)


_WINDOW_ROW = "window array<binary>, item string, shingles array<bigint>"


def windows_of(items: DataFrame) -> DataFrame:
    """``(window, item, shingles)``: the windows of each item with the hashes of their shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(runtime.values(batch, "item").to_pylist(), runtime.byte_texts(batch)):
                words = words_of(text)
                size, long_ = min(SHINGLE, len(words)), min(WINDOW, len(words))
                if not words:
                    continue
                x = shingles(_hashes(words), size).tolist()
                last = len(words) - long_ + 1
                for a in range(0, last, 5000):
                    some = range(a, min(last, a + 5000))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i : i + long_] for i in some], pa.list_(pa.binary())), pa.array([item] * len(some), pa.string()), pa.array([x[i : i + long_ - size + 1] for i in some], pa.list_(pa.int64()))], ["window", "item", "shingles"]
                    )
        runtime.trim()

    return items.mapInArrow(run, _WINDOW_ROW)


def _bits(key: str | Column) -> Column:
    """The bits of a shingle in its word of the filter: three of 64."""
    one = F.lit(1).cast("bigint")
    bit = lambda at: F.call_function("shiftleft", one, F.shiftrightunsigned(F.col(key), at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def bloom(keys: DataFrame, most: int = BLOOM_WORDS) -> np.ndarray:
    """A filter of the distinct values of ``keys.shingle``; its bounded table comes to the driver."""
    wanted = max(1, keys.count() * BLOOM_BITS // 64)
    n = min(most, 1 << (wanted - 1).bit_length())
    out = np.zeros(n, np.int64)
    rows = keys.groupBy(F.col("shingle").bitwiseAND(F.lit(n - 1)).alias("at")).agg(F.bit_or(_bits("shingle")).alias("bits")).toArrow()
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def passes(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which shingles may be in a filter."""
    u = x.view(np.uint64)
    bits = np.uint64(1) << (u >> np.uint64(40) & np.uint64(63)) | np.uint64(1) << (u >> np.uint64(46) & np.uint64(63)) | np.uint64(1) << (u >> np.uint64(52) & np.uint64(63))
    return filter_.view(np.uint64)[(u & np.uint64(len(filter_) - 1)).astype(np.int64)] & bits == bits


def _found(some: pa.Array, filter_: np.ndarray, sizes: list[int]) -> tuple:
    """Words of some texts, and the shingles that may be in a filter: text, place and hash of each, in order of place."""
    word, bounds, names = runtime.words(some, _WORDS)
    h = _hashes(names)[word] if names else np.zeros(0, np.uint64)
    texts, places, hashes = [], [], []
    for size in sizes:
        x = shingles(h, size)
        at = np.flatnonzero(passes(filter_, x))
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + size <= bounds[text + 1]
        texts.append(text[inside])
        places.append(at[inside])
        hashes.append(x[at[inside]])
    text, place, x = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (texts, places, hashes))
    by = np.argsort(place, kind="stable")
    return word, bounds, names, text[by], place[by], x[by]


def _frequencies(docs: DataFrame, filter_: np.ndarray, sizes: list[int]) -> DataFrame:
    """``(shingle, n)``: in how many documents each shingle of a filter is."""
    shared = docs.sparkSession.sparkContext.broadcast((filter_, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES):
                *_, text, _, x = _found(some, *shared.value)
                by = np.lexsort((text, x))
                text, x = text[by], x[by]
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
                key, n = np.unique(x[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["shingle", "n"])
        runtime.trim()

    return docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


_CANDIDATE = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.binary()))]))


def _candidates(docs: DataFrame, filter_: np.ndarray, sizes: list[int]) -> DataFrame:
    """``(doc_id, version, n_words, candidates)``: prefix shingles of each document with their place, the number of words before them that come along, and the words around."""
    shared = docs.sparkSession.sparkContext.broadcast((filter_, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES):
                word, bounds, names, text, place, x = _found(some, *shared.value)
                low, high = np.maximum(bounds[text], place - WINDOW + 1), np.minimum(bounds[text + 1], place + WINDOW)
                of: list[list[dict]] = [[] for _ in range(len(some))]
                for t, p, k, a, b, first in zip(text.tolist(), place.tolist(), x.tolist(), low.tolist(), high.tolist(), bounds[text].tolist()):
                    of[t].append({"shingle": k, "place": p - first, "before": p - a, "around": [names[i] for i in word[a:b]]})
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([runtime.values(part, "doc_id"), runtime.values(part, "version"), pa.array(np.diff(bounds), pa.int64()), pa.array(of, _CANDIDATE)], ["doc_id", "version", "n_words", "candidates"])
                at += len(some)
        runtime.trim()

    return docs.mapInArrow(run, "doc_id bigint, version bigint, n_words bigint, candidates array<struct<shingle:bigint,place:int,before:int,around:array<binary>>>")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(hits: DataFrame) -> DataFrame:
    """Merged spans and sorted items of the documents with hits."""
    by_doc = hits.groupBy("_id", "_none", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": a, "end": e} for a, e in merge([(s["start"], s["end"]) for s in row])] for row in runtime.values(b, "spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(runtime.values(b, c) for c in ("_id", "_none", "version")), pa.array(spans, _SPANS), runtime.values(b, "items")], ["_id", "_none", "version", "spans", "items"])

    return by_doc.mapInArrow(run, "_id bigint, _none boolean, version bigint, spans array<struct<start:int,end:int>>, items array<string>")


def find_contamination(documents: DataFrame, benchmark: DataFrame, bloom_words: int = BLOOM_WORDS) -> DataFrame:
    """Where windows of benchmark items occur in each document.

    Returns ``doc_id, version`` (hash of the text), ``n_words, spans`` (merged, in words)
    and ``items`` (sorted item_ids as strings), a row for each input row. Null and empty
    texts have no words; an item without words has no window; windows of items whose id
    is null hit words but name no item; items that repeat an id are one item; repeated
    documents stay repeated; other columns are ignored. Empty tables give no rows or no
    hits. ``bloom_words`` bounds what is broadcast and does not change results.
    """
    spark = documents.sparkSession
    runtime.ship(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    every = windows_of(items).groupBy("window").agg(F.any_value("shingles").alias("shingles"), F.collect_set("item").alias("items"))
    windows = runtime.table(every.withColumn("wid", F.monotonically_increasing_id()), "windows")
    sizes = [r.n for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect()]  # at most three

    keys = windows.select(F.explode("shingles").alias("shingle")).distinct()
    counted = runtime.table(_frequencies(docs, bloom(keys, bloom_words), sizes), "shingle-counts")
    ranked = windows.select("wid", F.posexplode("shingles").alias("offset", "shingle")).join(counted, "shingle", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
    prefixes = windows.drop("shingles").join(ranked.where("rarest.n > 0"), "wid").select("wid", "window", "items", "rarest.shingle", "rarest.offset")
    prefixes = runtime.table(prefixes, "prefixes")

    seen = runtime.table(_candidates(docs, bloom(prefixes.select("shingle").distinct(), bloom_words), sizes), "candidates")
    key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "version"]
    each = seen.where(F.size("candidates") > 0).select(*key, F.explode("candidates").alias("c")).select("_id", "_none", "version", "c.*")
    both = each.join(prefixes, "shingle")
    skip, n = F.col("before") - F.col("offset"), F.size("window")
    fits = (skip >= 0) & (skip + n <= F.size("around"))
    hits = both.where(fits & (F.when(fits, F.slice("around", F.greatest(skip, F.lit(0)) + 1, n)) == F.col("window")))
    start = F.col("place") - F.col("offset")
    found = _merged(hits.select("_id", "_none", "version", start.alias("start"), (start + n).alias("end"), "items"))
    out = seen.select("doc_id", "n_words", *key).join(found, ["_id", "_none", "version"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "version", "n_words", empty("spans", "array<struct<start:int,end:int>>"), empty("items", "array<string>"))


def verdicts(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_contamination``: contaminated means 5 % of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
