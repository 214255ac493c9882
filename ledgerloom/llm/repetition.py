"""Quality rules with repetition found by suffix arrays.

Words of many documents are sorted together: ranks of suffixes are doubled (by 1, 2,
4 ... words) inside each document until all differ, and only suffixes that still tie
go on, so a text without long repeats costs two rounds. Neighbours in the array and
the ranks of the first rounds give their longest common prefix; longer ones are found
by comparing words once for each diagonal. Its intervals are the maximal repeated
substrings; a stack visits them. The union of their occurrences gives the covered
words. All arrays are linear in the words of a block, of 4 or 8 bytes each.
"""

from __future__ import annotations

from array import array as py_array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

#: Least words of a repeated substring, and the limits: covered share of the words in per cent, words of the longest.
#: Covered words are among those in repeated three-word windows, so the first limit decides only below the base rule's 50.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 10, 50
WORDS_AT_ONCE = 1_000_000
#: Rounds of ranks that are kept: common prefixes of up to 15 words are read off them.
LEVELS = 4

_SPACES = bytes([9, 10, 11, 12, 13, 32])
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def suffix_ranks(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all documents, document by document, and the ranks of the first rounds.

    ``key``: the word at each place, different in each document; ``end``: where its
    document ends. Two places have the same rank in round l if their documents are the
    same and the 2**l words from them are. ``LEVELS`` rounds are kept.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)) if n else 0
    levels = [rank.copy()]
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(sizes > 1, sizes)].astype(np.int32)
    del order, new, sizes
    step = 1
    while len(active):
        ahead = active + step
        both = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        both += rank[active].astype(np.int64) * (n + 1) + 1
        by = np.argsort(both, kind="stable")
        active, both = active[by], both[by]
        del by, ahead
        old = rank[active]
        index = np.arange(len(active), dtype=np.int32)
        new_group = np.concatenate([[True], both[1:] != both[:-1]])
        del both
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        rank[active] = old + np.maximum.accumulate(np.where(new_group, index, 0)) - np.maximum.accumulate(np.where(new_old, index, 0))
        if len(levels) < LEVELS:
            levels.append(rank.copy())
        sizes = np.diff(np.append(np.flatnonzero(new_group), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    array = np.empty(n, np.int32)
    array[rank] = np.arange(n, dtype=np.int32)
    return array, levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray], end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Words that suffix i of the array shares with the one before it (0 across documents).

    Short ones are read off the kept ranks. Longer ones are found by comparing words, but
    once for each diagonal: where both suffixes begin one word later than another pair,
    they share one word less.
    """
    n = len(array)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    at = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b, shared = array[at], array[at - 1], np.zeros(len(at), np.int32)
    end_a, end_b = end[a], end[b]
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < end_a) & (b < end_b)
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        grown = same.astype(np.int32) << level
        a, b, shared = a + grown, b + grown, shared + grown
    out[at] = shared
    most = (1 << len(levels)) - 1
    long_ = at[shared == most]
    if len(levels) == LEVELS and len(long_):
        long_ = long_[np.argsort(array[long_], kind="stable")]  # by place in the text
        p, q = array[long_], array[long_ - 1]
        begins = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)]))
        reach = np.zeros(len(begins), np.int32)
        for k, i in enumerate(begins.tolist()):
            reach[k] = _extend(word, int(p[i]), int(q[i]), int(end[p[i]]), most)
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(p))))
        out[long_] = reach[run] - (p - p[begins][run])
    return out


def _extend(word: np.ndarray, p: int, q: int, end: int, shared: int) -> int:
    """How many words two places of a document share, ``shared`` at least."""
    room, step = end - max(p, q), 16
    while shared < room:
        n = min(step, room - shared)
        differ = word[p + shared : p + shared + n] != word[q + shared : q + shared + n]
        if differ.any():
            return shared + int(differ.argmax())
        shared, step = shared + n, step * 2
    return room


def maximal_repeats(array: np.ndarray, shared: np.ndarray, before: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals of common prefixes in array[low:high] whose repeats can't be extended to the left: (a place, words, occurrences).

    ``before``: the word before each place, -1 at a document's start.
    """
    changes = np.concatenate([[0], np.cumsum(before[array[low + 1 : high]] != before[array[low : high - 1]], dtype=np.int32)])
    starts = np.concatenate([[0], np.cumsum(before[array[low:high]] < 0, dtype=np.int32)])
    sizes, lefts = py_array("i"), py_array("i")  # a stack
    for i in range(low, high + 1):
        size = int(shared[i]) if low < i < high else 0
        left = i - 1
        while sizes and sizes[-1] > size:
            words, left = sizes.pop(), lefts.pop()
            wide = changes[i - 1 - low] != changes[left - low] or starts[i - low] > starts[left - low]
            if words >= least and wide:
                yield int(array[left]), words, i - left
        if size and (not sizes or sizes[-1] < size):
            sizes.append(size)
            lefts.append(left)


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> dict:
    """Numbers of each text as arrays: words, repeated three-word windows, covered words, longest repeat; and the repeats.

    The repeats are three flat arrays (place, words, occurrences) and the text of each.
    """
    word, bounds, names = runtime.words(texts)
    n, m = len(word), len(texts)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(m, dtype=np.int32), size)
    end = bounds[1:].astype(np.int32)[doc]
    array, levels = suffix_ranks(doc * np.int64(len(names) + 1) + word, end)
    shared = common_prefixes(array, levels, end, word)
    del levels
    best = np.zeros(n, np.int32)
    if n:
        best[array] = np.maximum(shared, np.append(shared[1:], 0))

    def covered(least: int, reach: np.ndarray | int) -> np.ndarray:
        mark = np.zeros(n + 1, np.int32)
        some = np.flatnonzero(best >= least)
        mark[some] += 1
        np.subtract.at(mark, some + (reach if isinstance(reach, int) else reach[some]), 1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:n]) > 0)])
        return inside[bounds[1:]] - inside[bounds[:-1]]

    longest = np.zeros(m, np.int32)
    np.maximum.at(longest, doc, best)
    longest[longest < min_repeat] = 0
    of, place, words, times = (py_array("i") for _ in range(4))
    if (longest > 0).any():
        before = np.concatenate([[-1], word[:-1]]).astype(np.int32)
        before[bounds[:-1][size > 0]] = -1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], shared >= min_repeat, [False]]).astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            d = int(doc[array[low]])
            first = int(bounds[d])
            for p, w, c in maximal_repeats(array, shared, before, low - 1, high, min_repeat):
                of.append(d)
                place.append(p - first)
                words.append(w)
                times.append(c)
    flat = [np.frombuffer(x, np.int32) for x in (of, place, words, times)]
    by = np.lexsort((flat[2], flat[1], flat[0]))
    return {"n_words": size, "n_repeat_words": covered(3, 3), "covered": covered(min_repeat, best), "longest": longest, "repeats": [x[by] for x in flat]}


def _lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered bigint, longest bigint, repeats array<struct<start:int,words:int,times:int>>"


def measure_repetition(documents: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """The numbers of each text and its maximal repeated substrings of ``min_repeat`` words or more.

    ``repeats``: the place of an occurrence, its words and how often it occurs;
    ``covered``: words in any occurrence. A row for each input row in no order; null
    and empty texts have zeros; repeated rows stay repeated; other columns are
    ignored; an empty table stays empty. Narrow: no shuffle; a task holds about a
    million words, or one text if that is longer, and some 100 bytes for each word.
    """
    runtime.ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in runtime.slices(runtime.values(batch, "text"), 6 * WORDS_AT_ONCE):
                m = measure(some, min_repeat)
                texts = [t or b"" for t in some.cast(pa.binary()).to_pylist()]
                of, *repeats = m["repeats"]
                offsets = np.searchsorted(of, np.arange(len(some) + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(x) for x in repeats], ["start", "words", "times"])
                columns = [
                    runtime.values(batch, "doc_id").slice(at, len(some)),
                    pa.array(m["n_words"], pa.int64()),
                    pa.array([len(t.translate(None, _NOT_COUNTED)) for t in texts], pa.int64()),
                    pa.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], pa.int64()),
                    pa.array([_lines(t) for t in texts], pa.int64()),
                    *(pa.array(m[k].astype(np.int64)) for k in ("n_repeat_words", "covered", "longest")),
                    pa.ListArray.from_arrays(pa.array(offsets), structs),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest", "repeats"])
                at += len(some)
        runtime.trim()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def judge(measured: DataFrame, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Add ``base_failed`` and ``kept``: the base rule holds and repeats cover at most ``max_covered`` per cent, none longer than ``max_longest`` words."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (100 * F.col("covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & method)
