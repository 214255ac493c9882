"""Sections of pages, token vectors and ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars, text

INTRO = "Introduction"
#: Rank constant of reciprocal rank fusion, and BM25-style inverse document frequency: parameters, not facts.
RRF_K = 60


def without_frontmatter(markdown: Column) -> Column:
    return F.regexp_replace(F.replace(markdown, F.lit("\r\n"), F.lit("\n")), "(?s)\\A---\n.*?\n---\n", "")


def sections(pages: DataFrame, page_id: str, markdown: str, intro: str = INTRO, placeholder: str = "^\\(notes from .*\\)\\s*$") -> DataFrame:
    """``(page_id, pos, section, text)``: the second-level sections of each page.

    What is before the first is the introduction, without the title and quotes. Rules
    at the end, note placeholders and empty sections go; a repeated name gets the first
    free ``(2)``, ``(3)`` ... in order. A page is handled in its row: nothing is shuffled.
    """
    page, done = _sections(pages, [page_id], markdown, intro, placeholder)
    return page.select(page_id, F.posexplode(done).alias("pos", "s")).select(page_id, "pos", "s.section", "s.text")


def section_lists(pages: DataFrame, markdown: str, intro: str = INTRO, placeholder: str = "^\\(notes from .*\\)\\s*$") -> DataFrame:
    """All columns of pages, and their ``sections`` as an array of ``section, text``."""
    kept = [c for c in pages.columns if c != "sections"]
    page, done = _sections(pages, kept, markdown, intro, placeholder)
    return page.select(*kept, done.alias("sections"))


def _sections(pages: DataFrame, kept: list[str], markdown: str, intro: str, placeholder: str) -> tuple[DataFrame, Column]:
    """Pages with what their sections are made of, and the sections: to be used in one place, as each use computes them anew."""
    blank = "[ \\t\\r\\n\\f\\x0b]"
    lines = F.split(without_frontmatter(F.col(markdown)), "\n")
    # Places of the headers; the introduction begins before the first line.
    heads = F.concat(F.array(F.lit(-1)), F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("## "), i)), lambda i: i.isNotNull()))
    page = pages.select(*kept, lines.alias("_lines"), heads.alias("_heads"))
    line, head = F.col("_lines"), F.col("_heads")

    def body(at: Column, i: Column) -> Column:
        upto = F.coalesce(F.try_element_at(head, i + 2), F.size(line))
        own = F.filter(F.slice(line, at + 2, upto - at - 1), lambda x: ~(x.rlike(placeholder) | ((i == 0) & (x.startswith("# ") | x.startswith(">")))))
        return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), f"^{blank}+|{blank}+$", ""), f"({blank}*---)+$|^(---)+$", "")

    name = lambda at: F.when(at < 0, intro).otherwise(F.trim(F.substring(F.element_at(line, at + 1), 4, 1 << 30)))
    found = F.transform(head, lambda at, i: F.struct(F.when(at < 0, F.lit(intro)).otherwise(name(F.greatest(at, F.lit(0)))).alias("section"), body(at, i).alias("text")))
    page = page.select(*kept, F.filter(found, lambda s: s["text"] != "").alias("_found"))
    page = page.withColumn("_names", F.transform("_found", lambda s: s["section"]))
    names = F.col("_names")

    # Names that end in a number may be taken by a repetition of another; then they are given one after another.
    def free(taken: Column, own: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.when(n == 1, own).otherwise(F.concat(own, F.lit(" ("), n.cast("string"), F.lit(")"))))
        return F.element_at(F.filter(tries, lambda t: ~F.array_contains(taken, t)), 1)

    in_turn = F.aggregate(names, F.array().cast("array<string>"), lambda taken, own: F.array_append(taken, free(taken, own)))
    counted = F.transform(names, lambda own, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: x == own)))
    by_count = F.zip_with(names, counted, lambda own, n: F.when(n == 1, own).otherwise(F.concat(own, F.lit(" ("), n.cast("string"), F.lit(")"))))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    shown = F.when(unique, names).when(F.exists(names, lambda x: x.rlike(" \\([0-9]+\\)$")), in_turn).otherwise(by_count)
    done = F.zip_with(shown, "_found", lambda n, s: F.struct(n.alias("section"), s["text"].alias("text")))
    return page, done


def token_frequencies(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(doc, token, tf)``, counted inside the row before anything moves."""
    return docs.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count(F.lit(1)).alias("tf"))


def fnv1a(tokens: pa.Array) -> np.ndarray:
    """32-bit FNV-1a of the UTF-8 bytes of each text of an array, all of them byte by byte together."""
    tokens = tokens.cast(pa.large_binary())
    offsets = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, 8 * tokens.offset)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    sizes, h, left, at = np.diff(offsets), np.full(len(tokens), 2166136261, np.uint64), np.arange(len(tokens)), 0
    while len(left := left[sizes[left] > at]):
        h[left] = (h[left] ^ data[offsets[left] + at]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
        at += 1
    return h.astype(np.int64)


def _counts(lists: pa.Array, numbers: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with lists of tokens: row, number and count of each distinct (row, number); negative numbers are left out."""
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    kept = numbers >= 0
    key, n = np.unique(row[kept] * np.int64(distinct) + numbers[kept], return_counts=True)
    return key // distinct, key % distinct, n


#: Tokens that are counted together; memory of a task follows it, not the rows of a batch or their lengths.
TOKENS = 1 << 18


def _slices(batch: pa.RecordBatch, column: int = 1, most: int | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch in stretches of rows whose lists together have at most ``most`` items (a row is never cut), and where they begin."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + (most or TOKENS), "right")))
        yield first, batch.slice(first, last - first)
        first = last


def hashed(docs: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(doc, idx, tf)``: ascending ids of the tokens and their counts; tokens of one id merge. Rows without tokens go.

    The tokens of a row stay in it: nothing is shuffled, and some rows at a time hash each
    of their distinct tokens once.
    """
    own = docs.select(doc, tokens.alias("_tokens"))
    kind = own.schema[doc].dataType.simpleString()

    def run(batches):
        for _, batch in (s for whole in batches for s in _slices(whole)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            row, h, n = _counts(lists, fnv1a(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64), 1 << 32)
            some, starts = np.unique(row, return_index=True)
            offsets = pa.array(np.append(starts, len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))], [doc, "idx", "tf"])

    return own.mapInArrow(run, f"`{doc}` {kind}, idx array<bigint>, tf array<bigint>")


def sparse_vectors(vectors: DataFrame, doc: str) -> DataFrame:
    """``(doc, idx, val)``: ascending token ids and their counts."""
    return vectors.select(doc, "idx", F.transform("tf", lambda n: n.cast("float")).alias("val"))


def dense_vectors(vectors: DataFrame, doc: str, dimensions: int) -> DataFrame:
    """``(doc, dense)``: the hashed bag of words, of length 1, as an array of all cells."""
    kind = vectors.schema[doc].dataType.simpleString()

    def run(batches):
        for _, batch in (s for whole in batches for s in _slices(whole)):
            idx, tf = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(idx).to_numpy())
            cells = np.bincount(row * dimensions + idx.flatten().to_numpy() % dimensions, weights=tf.flatten().to_numpy(), minlength=batch.num_rows * dimensions).reshape(-1, dimensions)
            cells /= np.sqrt((cells * cells).sum(axis=1, keepdims=True))
            offsets = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], [doc, "dense"])

    return vectors.select(doc, "idx", "tf").mapInArrow(run, f"`{doc}` {kind}, dense array<double>")


def dense_cells(vectors: DataFrame, doc: str, dimensions: int) -> DataFrame:
    """``(doc, cell, x)``: the same, by its cells that are not zero."""
    return dense_vectors(vectors, doc, dimensions).select(doc, F.posexplode("dense").alias("cell", "x")).where("x > 0").select(doc, F.col("cell").cast("bigint").alias("cell"), "x")


def idf(docs: DataFrame, tokens: Column, wanted: DataFrame, n_docs: int) -> DataFrame:
    """``(token, idf)`` of the tokens in ``wanted``: ln(1 + (N - df + 0.5) / (df + 0.5)); counted inside partitions before anything moves."""
    each = docs.select(F.explode(F.array_distinct(tokens)).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


#: Queries that are scored together; more are scored in further readings of the documents.
QUERY_BLOCK = 512


def _blocks(queries: DataFrame, query: str) -> list[DataFrame]:
    n = queries.select(query).distinct().count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    return [queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [queries]


def _best(docs: DataFrame, doc: str, ids: pa.Array, query: str, score, k: int, digits: int) -> DataFrame:
    """``(query, doc, score)``: of each partition the best k documents of each query, ties by document.

    ``score(batch)`` gives a row for each document and a column for each query; NaN is no match.
    """
    kind = docs.schema[doc].dataType.simpleString()
    asked = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int"}[ids.type]

    def run(batches):
        held: list[tuple] = [(np.zeros(0), None)] * len(ids)
        for batch in batches:
            scores = score(batch)
            for q in range(len(ids)):
                s = scores[:, q]
                at = np.flatnonzero(~np.isnan(s))
                if len(at) > k:  # what can't be among the best goes before the sort
                    at = at[np.round(s[at], digits) >= np.round(np.partition(s[at], -k)[-k], digits)]
                if not len(at):
                    continue
                old, names = held[q]
                s, keys = np.concatenate([old, s[at]]), batch.column(0).take(pa.array(at))
                keys = keys if names is None else pa.concat_arrays([names, keys])
                order = np.lexsort((np.array(pc.rank(keys, tiebreaker="min")), -np.round(s, digits)))[:k]
                held[q] = s[order], keys.take(pa.array(order))
        some = [q for q in range(len(ids)) if len(held[q][0])]
        if some:
            which = np.repeat(some, [len(held[q][0]) for q in some])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.concat_arrays([held[q][1] for q in some]), pa.array(np.concatenate([held[q][0] for q in some]))], [query, doc, "score"])

    return docs.mapInArrow(run, f"`{query}` {asked}, `{doc}` {kind}, score double")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sparse_best(docs: DataFrame, doc: str, tokens: Column, queries: DataFrame, query: str, k: int, digits: int = 9) -> DataFrame:
    """The best k documents of each query by the dot product of counts with weights, with ``rank``.

    ``queries``: ``query, token, weight`` (a query's tokens are bounded by its text). The
    documents are read once for a block of queries; a task keeps k documents of each.
    """
    parts = []
    for block in _blocks(queries, query):
        rows = block.select(query, "token", "weight").toArrow()
        ids, vocabulary = pc.unique(rows.column(0)), pc.unique(rows.column(1))
        weights = np.zeros((len(vocabulary), len(ids)))
        np.add.at(weights, (pc.index_in(rows.column(1), vocabulary).to_numpy(), pc.index_in(rows.column(0), ids).to_numpy()), rows.column(2).to_numpy())

        def some(batch, vocabulary, weights):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)
            row, token, n = _counts(lists, known[coded.indices.to_numpy()].astype(np.int64), max(1, len(vocabulary)))
            out = np.full((batch.num_rows, weights.shape[1]), np.nan)
            step = max(1, (1 << 21) // max(1, weights.shape[1]))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + step, "right")) - 1)
                a, b = bounds[first], bounds[last]
                if b > a:
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(row[a:b]) > 0]))
                    sums = np.add.reduceat(weights[token[a:b]] * n[a:b, None], starts, axis=0)
                    out[row[a:b][starts]] = np.where(sums > 0, sums, np.nan)
                first = last
            return out

        def score(batch, vocabulary=vocabulary, weights=weights):
            return np.concatenate([some(part, vocabulary, weights) for _, part in _slices(batch)]) if batch.num_rows else np.zeros((0, weights.shape[1]))

        parts.append(_best(docs.select(doc, tokens.alias("_tokens")), doc, ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, query, score, k, digits))
    return ranked(_union(parts), query, doc, k, digits)


def dense_best(docs: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, wanted: str, k: int, digits: int = 9) -> DataFrame:
    """The best k documents of each query by cosine, with ``rank``; a zero vector has cosine 0 with all. Read once for a block of queries."""
    parts = []
    for block in _blocks(queries, query):
        rows = block.select(query, wanted).toArrow()
        ids = rows.column(0).combine_chunks()
        q = np.array(rows.column(1).to_pylist(), np.float64).reshape(len(rows), -1)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)

        def score(batch, q=q):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ q.T

        parts.append(_best(docs.select(doc, vector).where(F.col(vector).isNotNull()), doc, ids, query, score, k, digits))
    return ranked(_union(parts), query, doc, k, digits)


def ranked(scores: DataFrame, query: str, doc: str, k: int, digits: int = 9) -> DataFrame:
    """The best k of each query with ``rank``; ties by document."""
    order = Window.partitionBy(query).orderBy(F.round("score", digits).desc(), doc)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: list[DataFrame], query: str, doc: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``(query, doc, score)``."""
    both = lists[0].select(query, doc, "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select(query, doc, "rank"))
    return both.groupBy(query, doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def keyword_scores(docs: DataFrame, query: str, stems: str, most: int = 5) -> DataFrame:
    """Documents by the share of the query's distinct stems that they have; the best with any, ties in document order.

    ``docs``: ``pos, page_id, text``.
    """
    asked = F.array_distinct(text.stems(F.lit(query)))
    score = F.size(F.array_intersect(F.array_distinct(F.col(stems)), asked)) / F.greatest(F.size(asked), F.lit(1))
    return docs.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "pos").limit(most)


def offline_answer(hits: DataFrame, query: str, order: str, title: str, body: str, nothing: str = "Nothing found.") -> DataFrame:
    """``(query, answer)``: numbered snippets in order, or a fixed sentence for a query without hits (``body`` null)."""
    line = F.struct(F.col(order).alias("o"), F.concat(F.col(order).cast("string"), F.lit(". "), F.col(title), F.lit(": "), scalars.snippet(F.col(body))).alias("v"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col(body).isNotNull(), line))), lambda s: s["v"])
    return hits.groupBy(query).agg(lines.alias("_l")).select(query, F.when(F.size("_l") > 0, F.array_join("_l", "\n")).otherwise(nothing).alias("answer"))


def rerank(hits: DataFrame, query: str, doc: str, scores: DataFrame | None, k: int) -> DataFrame:
    """The best k by new scores ``(query, doc, score)``; without these the order (``rank``) and old scores stay."""
    if scores is None:
        return hits.where(F.col("rank") <= k)
    return ranked(hits.drop("score", "rank").join(scores, [query, doc]), query, doc, k)
