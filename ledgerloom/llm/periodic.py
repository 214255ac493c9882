"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with a smallest period q that cannot be made longer on
either side; it has at least ``LEAST`` words and ``TIMES`` periods. For each period p
the words at the places jp, (j+1)p and (j+2)p of a grid are compared: a run of three
periods holds three of them in a row, and all words between the first two must equal
those p later, of which a few more are probed. There are n/p places for each p, so
n log n probes in all, made as arrays. What survives is extended to both sides by
comparing chunks of growing size. Grid places inside a run that was found are skipped:
those of the same period, and those whose three words lie in a run of a smaller one
(by the theorem of Fine and Wilf no run of a longer period can hold them). An extension
that shares p + q words with a run of a smaller period q is given up for the same reason.

Documents are independent, so there is no shuffle; a task holds about ``BLOCK_BYTES`` of
texts, or one text, and ``PROBES`` probes at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime

LEAST, TIMES = 24, 3
BLOCK_BYTES, PROBES = 8_000_000, 1 << 14
#: While more than ``FEW`` grid points survive, words at up to ``MORE`` places between two neighbours are probed, too.
FEW, MORE, _GOLDEN = 4, 40, 0.6180339887498949


def _survivors(words: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Period and place of the grid points from period ``low`` to below ``high`` whose probes are all equal."""
    n = len(words)
    periods = np.arange(low, high)
    sizes = (n - 1 - 2 * periods) // periods + 1  # places x = 0, p, 2p, ... with x + 2p < n
    p = np.repeat(periods, sizes)
    ends = np.cumsum(sizes)
    x = (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)) * p
    at = np.flatnonzero(words[x] == words[x + p])
    p, x = p[at], x[at]
    same = words[x + p] == words[x + 2 * p]
    p, x = p[same], x[same]
    for k in range(1, MORE):
        if len(p) <= FEW:
            break
        y = x + (p * (k * _GOLDEN % 1)).astype(np.int64)
        same = words[y] == words[y + p]
        p, x = p[same], x[same]
    return p, x


def _agree(words: np.ndarray, a: int, step: int, p: int, most: int) -> int:
    """How many of up to ``most`` words from ``a`` on, in direction ``step``, equal those p later."""
    if step > 0:
        differ = words[a : a + most] != words[a + p : a + p + most]
    else:
        differ = (words[a - most + 1 : a + 1] != words[a - most + 1 + p : a + 1 + p])[::-1]
    at = int(differ.argmax()) if most else 0
    return at if most and differ[at] else most


class _Found:
    """Runs found so far, all of smaller or the same period."""

    def __init__(self) -> None:
        self.start, self.end, self.period = (np.zeros(16, np.int64) for _ in range(3))
        self.n = 0

    def add(self, start: int, end: int, period: int) -> None:
        if self.n == len(self.start):
            self.start, self.end, self.period = (np.concatenate([x, np.zeros(self.n, np.int64)]) for x in (self.start, self.end, self.period))
        self.start[self.n], self.end[self.n], self.period[self.n] = start, end, period
        self.n += 1

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the stretches [start, end) lie in a run."""
        if not self.n:
            return np.zeros(len(start), bool)
        by = np.argsort(self.start[: self.n], kind="stable")
        furthest = np.concatenate([[0], np.maximum.accumulate(self.end[: self.n][by])])
        return furthest[np.searchsorted(self.start[: self.n][by], start, "right")] >= end

    def holds(self, start: int, end: int, p: int) -> bool:
        """Whether a run of a smaller period shares so many words with [start, end), which has period p, that this one's smallest period is smaller, too."""
        if not self.n:
            return False
        own = self.period[: self.n]
        shared = np.minimum(self.end[: self.n], end) - np.maximum(self.start[: self.n], start)
        return bool(((own < p) & (shared >= p + own)).any())


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by start and period."""
    n, found = len(words), _Found()
    if n < LEAST:
        return []
    most = n // TIMES
    low = 1
    while low <= most:
        high, probes = low, 0
        while high <= most and (high == low or probes + n // high <= PROBES):
            probes += n // high
            high += 1
        last, done = 0, -1  # the period and the end of the stretch that was extended last
        p, x = _survivors(words, low, high)
        fresh = ~found.inside(x, x + 2 * p + 1)
        for p, x in zip(p[fresh].tolist(), x[fresh].tolist()):
            if p == last and x < done or found.holds(x, x + 2 * p + 1, p):
                continue
            left, right = x, x + 1  # words [left, right) equal those p later
            size, up, down, given_up = 16, True, True, False
            while (up or down) and not given_up:
                if up:
                    room = min(size, n - p - right)
                    got = _agree(words, right, 1, p, room)
                    right, up = right + got, got == size
                if down:
                    room = min(size, left)
                    got = _agree(words, left - 1, -1, p, room)
                    left, down = left - got, got == size
                size *= 2
                given_up = found.holds(left, right + p, p)
            last, done = p, right
            if not given_up and right + p - left >= max(LEAST, TIMES * p):
                found.add(left, right + p, p)
        low = high
    out = [(int(s), int(e - s), int(p)) for s, e, p in zip(found.start[: found.n], found.end[: found.n], found.period[: found.n])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words, in every tenth document (by the checksum of its id) from some place on made periodic; a null id never is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not len(words):
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[np.concatenate([np.arange(a), a + np.arange(n - a) % p])]


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of several the first, then the one with the smallest period."""
    out = None
    for run in found:  # by start and period, so that only a greater one takes the place
        if out is None or run[1] * out[2] > out[1] * run[2]:
            out = run
    return out


_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"


def detect_runs(documents: DataFrame, plant: bool = False) -> DataFrame:
    """The runs of each text, the one with most periods, and the text without repeated periods.

    ``runs`` are in order of start and period, ``best`` is null without any, and
    ``collapsed`` holds the words that stay, joined by blanks. A row for each input row in
    no order; null and empty texts have no words; repeated rows stay repeated; other
    columns are ignored; an empty table stays empty; a text is always taken whole, with
    memory in proportion to its words. ``plant`` first makes the end of every tenth
    document periodic (``planted``).
    """
    runtime.ship(documents.sparkSession)
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    named = lambda r: dict(zip(("start", "length", "period"), r)) if r else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in runtime.slices(runtime.values(batch, "text"), BLOCK_BYTES):
                ids = runtime.values(batch, "doc_id").slice(at, len(some))
                at += len(some)
                word, bounds, names = runtime.words(some)
                sizes, every, first, texts = [], [], [], []
                for i, key in enumerate(ids.to_pylist()):
                    own = word[bounds[i] : bounds[i + 1]]
                    if plant:
                        own = planted(own, key)
                    found = runs(own)
                    sizes.append(len(own))
                    every.append([named(r) for r in found])
                    first.append(named(best(found)))
                    kept = own[~dropped(len(own), found)] if found else own
                    texts.append(b" ".join([names[w] for w in kept.tolist()]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(every, pa.list_(triple)), pa.array(first, triple), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])
        runtime.trim()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def runs_digest(found: list[tuple[int, int, int]]) -> str:
    """SHA-256 of the lines ``start,length,period``."""
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
