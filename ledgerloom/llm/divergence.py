"""How the sources of a language differ in their terms.

Terms are runs of ASCII letters and bytes beyond ASCII, with A-Z lower-cased. A table of
256 entries maps the concatenated UTF-8 bytes of many texts, and the places where it
changes between letter and other are the boundaries. Slices are grouped by XXH64, worked
out for all slices of a length at once, and compared with the first of their group byte
by byte; a slice that differs gets a group of its own. A task sends on one row for each
(language, source, term) that it meets, so that hot sources and frequent terms are
combined before the shuffle.

A language keeps the terms of at least ``MIN_DOCS`` documents. The cells (source, term)
are dealt to blocks by term, of about ``CELLS`` each; a block holds a matrix of sources
by terms in compressed sparse rows and adds up its part of all divergences by ``reduceat``
over rows. The parts are integers, so their sums are exact in any order. Between sources
this is a table of all pairs of a language's sources, as asked for; terms are never paired.

All shares are integers: 1 + floor(1e9 (count + 5) / (N + 5 V)), worked out by three
divisions that stay below 2**63 for up to 9e15 terms of a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

MIN_DOCS, TOP, SMOOTH = 30, 50, 5
BLOCK_BYTES, ROWS_AT_ONCE, CELLS = 8_000_000, 1_000_000, 1 << 16

#: What each byte becomes: letters stay, A-Z become a-z, all others 0.
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: The five primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes of some texts, and where each term starts and ends and which text it is from."""
    offsets, data = runtime.parts(texts)
    offsets, data = offsets.astype(np.int64), LETTERS[data]
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 3
    letter = data > 0
    begins = np.zeros(len(data) + 1, bool)  # of texts, and the end of the last
    begins[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | begins[1:-1]
    last[:-1] &= ~letter[1:] | begins[1:-1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(slices: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of a matrix of bytes with fewer than 32 columns."""
    n, size = slices.shape
    h = np.full(n, _P5 + np.uint64(size), np.uint64)
    at = 0
    while at + 8 <= size:
        lane = np.ascontiguousarray(slices[:, at : at + 8]).view("<u8")[:, 0]
        h = _rotated(h ^ _rotated(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        at += 8
    if at + 4 <= size:
        lane = np.ascontiguousarray(slices[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        h = _rotated(h ^ lane * _P1, 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _rotated(h ^ slices[:, k].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _by_length(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(sizes[some[0]]), some


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's group, and what the groups are."""
    sizes = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    classes = list(_by_length(sizes))
    for size, some in classes:
        if size < 32:
            hashes[some] = xxh64(data[starts[some][:, None] + np.arange(size)])
        else:
            hashes[some] = [xxhash.xxh64_intdigest(data[s : s + size]) for s in starts[some].tolist()]
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    number = number.reshape(-1)
    like = first[number]
    differs = sizes != sizes[like]
    for size, some in classes:
        some = some[~differs[some] & (like[some] != some)]
        if size >= 32:
            differs[some] = [(data[s : s + size] != data[t : t + size]).any() for s, t in zip(starts[some].tolist(), starts[like[some]].tolist())]
            continue
        for part in np.array_split(some, max(1, len(some) * size // (64 << 20))):
            own, other = (data[s[:, None] + np.arange(size)] for s in (starts[part], starts[like[part]]))
            differs[part] = (own != other).any(axis=1)
    names = [data[starts[i] : ends[i]].tobytes() for i in first.tolist()]
    again: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():  # the same hash, other bytes
        number[i] = again.setdefault(data[starts[i] : ends[i]].tobytes(), len(names) + len(again))
    return number, names + list(again)


_CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_block(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """For each (language, source, term) of some documents how often it occurs and in how many of them."""
    data, starts, ends, of = boundaries(texts)
    number, names = grouped(data, starts, ends)
    k = max(1, len(names))
    # Once for each document and term, then for each group of documents and term.
    pair, times = np.unique(of * k + number, return_counts=True)
    both = pa.StructArray.from_arrays([langs, sources], ["lang", "source"])
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    group_of = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    groups, one, group = np.unique(group_of, return_index=True, return_inverse=True)
    cell = group.reshape(-1)[pair // k] * k + pair % k
    cells, back = np.unique(cell, return_inverse=True)
    n = np.bincount(back.reshape(-1), weights=times, minlength=len(cells)).astype(np.int64)
    docs = np.bincount(back.reshape(-1), minlength=len(cells))
    rows = both.take(pa.array(one[cells // k]))
    terms = pa.array(names, pa.binary()).take(pa.array(cells % k)) if names else pa.array([], pa.binary())
    columns = [rows.field("lang").cast(pa.string()), rows.field("source").cast(pa.string()), terms.cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))]
    return pa.Table.from_arrays(columns, schema=_CELL)


def _combined(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    summed = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select([*keys, "n_sum", "docs_sum"]).rename_columns(_CELL.names)


def count_terms(documents: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs``; nulls count as empty."""
    runtime.ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            at = 0
            for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES):
                own = batch.slice(at, len(some))
                at += len(some)
                held.append(count_block(runtime.values(own, "lang"), runtime.values(own, "source"), some))
                if sum(t.num_rows for t in held) > ROWS_AT_ONCE:
                    held = [_combined(held)]
                    if held[0].num_rows > ROWS_AT_ONCE // 2:
                        yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _combined(held).to_batches(1 << 16)
        del held
        runtime.trim()

    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(1e9 (count + 5) / (total + 5 kept)), exactly."""
    below = total + SMOOTH * kept
    if below >= 2**63 // 1000:
        raise OverflowError("a source has too many terms")
    rest, out = counts.astype(np.int64) + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // below
        rest = rest * 1000 % below
    return out + 1


def _block(sources: list[str], totals: np.ndarray, kept: int, row: np.ndarray, col: np.ndarray, n: np.ndarray, n_terms: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The part of a language that is in a block: divergences between all sources, and each source's greatest (source, term, value).

    ``row`` and ``col`` are ascending; terms are in byte order.
    """
    size = len(sources)
    bounds = np.searchsorted(row, np.arange(size + 1))
    zero = np.array([shares(np.zeros(1, np.int64), int(t), kept)[0] for t in totals]) if kept else np.zeros(size, np.int64)
    p = np.concatenate([shares(n[a:b], int(t), kept) for a, b, t in zip(bounds[:-1], bounds[1:], totals)]) if len(n) else n
    of_lang = shares(_sums(col, n, n_terms), int(totals.sum()), kept) if n_terms else np.zeros(0, np.int64)
    out = np.zeros((size, size), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    for s in range(size):
        own = slice(bounds[s], bounds[s + 1])
        dense = np.full(n_terms, zero[s])
        dense[col[own]] = p[own]
        # As if no other source had any of the terms: terms of s, then those that s has not, either.
        ordered = np.sort(p[own])
        before = np.concatenate([[0], np.cumsum(ordered)])
        k = np.searchsorted(ordered, zero)
        value = zero * k - before[k] + before[-1] - before[k] - zero * (len(ordered) - k) + (n_terms - len(ordered)) * np.abs(zero[s] - zero)
        if len(full):
            here = dense[col]
            value[full] += np.add.reduceat(np.abs(here - p) - np.abs(here - zero[row]), bounds[full])
        out[s] = value
    greatest = []
    over = p - of_lang[col] if len(n) else n
    for s in full.tolist():
        own = np.arange(bounds[s], bounds[s + 1])
        own = own[(over[own] > 0) & (n[own] > 0)]
        own = own[np.lexsort((col[own], -over[own]))[:TOP]]
        greatest += [(s, int(col[i]), int(over[i])) for i in own.tolist()]
    return out, greatest


def _sums(col: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, col, n)
    return out


_PART = "lang string, source string, part string, item string, value bigint"


def audit(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value`` and ``rank``.

    Part ``pair``: every other source of the language and the sum of the absolute
    differences of shares; part ``term``: up to ``TOP`` terms that the source has more
    often than the language, with the difference. Null ``lang``, ``source`` and ``text``
    count as empty. Sources without terms, and languages that keep none, have pairs, too
    (value 0 without terms); a language with one source has no pairs; repeated rows all
    count; ties rank by item; other columns are ignored; an empty table gives an empty
    one; texts are counted whole, whatever their length.
    """
    spark = documents.sparkSession
    cells = runtime.table(count_terms(documents), "divergence-counts")
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    cells = runtime.table(cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-cells")
    blocks = max(1, -(-cells.count() // CELLS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")

    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "kept"])
    # Each block gets the totals of all sources, as rows without a term.
    heads = groups.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "kept")
    rows = heads.unionByName(cells.select(block, "lang", "source", "term", "n", F.lit(0).cast("bigint").alias("kept")))
    runtime.ship(spark)

    def measure(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        out: list[tuple[str, str, str, str, int]] = []
        frame = group.combine_chunks()
        own = frame.column("lang").combine_chunks().dictionary_encode() if frame.num_rows else None
        head = frame.column("term").is_null().to_numpy(zero_copy_only=False) if frame.num_rows else None
        for i, lang in enumerate(own.dictionary.to_pylist()):
            here = own.indices.to_numpy() == i
            first, rest = frame.filter(pa.array(here & head)), frame.filter(pa.array(here & ~head))
            if not rest.num_rows and number:
                continue
            first = first.sort_by("source")
            sources = first.column("source").to_pylist()
            place = {s: k for k, s in enumerate(sources)}
            terms = sorted(set(rest.column("term").cast(pa.binary()).to_pylist()))
            at = {t: k for k, t in enumerate(terms)}
            row = np.array([place[s] for s in rest.column("source").to_pylist()], np.int64)
            col = np.array([at[t] for t in rest.column("term").cast(pa.binary()).to_pylist()], np.int64)
            by = np.lexsort((col, row))
            values, greatest = _block(sources, first.column("n").to_numpy(), first.column("kept")[0].as_py(), row[by], col[by], rest.column("n").to_numpy()[by], len(terms))
            out += [(lang, a, "pair", b, int(values[x, y])) for x, a in enumerate(sources) for y, b in enumerate(sources) if x != y]
            out += [(lang, sources[s], "term", terms[t].decode(), value) for s, t, value in greatest]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])

    parts = runtime.table(rows.groupBy("block").applyInArrow(measure, _PART), "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
