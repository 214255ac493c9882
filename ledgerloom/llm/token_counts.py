"""Token counts without token ids: pieces of distinct pre-tokens, joined to frequencies.

1. Texts are pre-tokenised in blocks (at most ``BLOCK_CHARS`` characters of a task's
   documents). A block numbers its distinct pre-tokens, the commonest first, and keeps
   of each document only (number, frequency) pairs, packed for many documents
   together. This is written once to the shared folder.
2. The blocks' vocabularies are dealt by pre-token and sorted, so equal pre-tokens of
   all blocks are neighbours: the tokenizer counts the pieces of each once.
3. The counts go back to their blocks, without the pre-tokens, meet the packed
   frequencies and are summed for each document.

A pre-token travels once for each block that has it, however many documents do. The
commonest, which nearly every block has, are dealt by pre-token and some hash values of
their block, so the rows of a hot one are spread and it is counted a bounded number of
times; all others are counted once.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import runtime
ODD = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")

BLOCK_CHARS, PACK_DOCS, ENCODE_ROWS = 32_000_000, 512, 20_000
#: A block ends at so many distinct pre-tokens, too, as its dictionaries grow with them.
BLOCK_NAMES = 1_000_000
#: So many of a block's commonest pre-tokens are dealt by pre-token and a hash of the block with so many values.
HOT_NUMBERS, SALTS = 4096, 64

_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^ \t\n\rA-Za-zÀ-ÖØ-öø-ɏ0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: White space whose pre-tokens depend on more than the piece between two single blanks.
_MIXED = re.compile(r"[ \t\n\r] | [ \t\n\r]|^[ \t\n\r]|[ \t\n\r]$")


class ByteBpe:
    """A byte-level ``.json`` tokenizer: its pre-tokens, and pieces of a pre-token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level tokenizer without normalizer and added blanks is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text around added tokens, and their number (one token each)."""
        if not self.special or "<" not in text:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def pretokens(self, text: str) -> list[str]:
        if not ODD.search(text):
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class _Block:
    """Frequencies of the pre-tokens of some documents."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.chars = bpe, 0
        self.number: dict[str, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.docs: list[tuple[int | None, int, int, np.ndarray, np.ndarray]] = []

    def _numbers(self, pretokens: list[str]) -> tuple[int, ...]:
        number = self.number
        return tuple([number.setdefault(p, len(number)) for p in pretokens])

    def add(self, doc_id: int | None, n_bytes: int, text: str) -> None:
        self.chars += len(text)
        n: dict[int, int] = {}
        segments, special = self.bpe.segments(text)
        for segment in segments:
            if not segment:
                continue
            if ODD.search(segment) or _MIXED.search(segment):
                for p, c in Counter(self.bpe.pretokens(segment)).items():
                    i = self.number.setdefault(p, len(self.number))
                    n[i] = n.get(i, 0) + c
                continue
            first, *rest = segment.split(" ")  # single blanks: each piece is split by itself
            for i in self._numbers(_FAST.findall(first)):
                n[i] = n.get(i, 0) + 1
            known = self.known
            for piece, c in Counter(rest).items():
                numbers = known.get(piece)
                if numbers is None:
                    numbers = known[piece] = self._numbers(_FAST.findall(" " + piece))
                for i in numbers:
                    n[i] = n.get(i, 0) + c
        self.docs.append((doc_id, n_bytes, special, np.fromiter(n.keys(), np.int64, len(n)), np.fromiter(n.values(), np.int64, len(n))))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Vocabulary rows, then packs of documents."""
        often = np.zeros(len(self.number), np.int64)
        for *_, numbers, _ in self.docs:
            often[numbers] += 1
        order = np.argsort(-often, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        names = list(self.number)
        for i in range(0, len(names), 50_000):
            some = order[i : i + 50_000].tolist()
            yield _batch([block] * len(some), list(range(i, i + len(some))), [names[k].encode() for k in some], [None] * len(some))
        for some in runtime.chunks(self.docs, PACK_DOCS):
            yield _batch([block], [None], [None], [pack(some, place)])


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(docs: list, place: np.ndarray) -> bytes:
    """Documents with their pre-token numbers (sorted, as differences) and frequencies."""
    numbers, counts = [], []
    for *_, own, c in docs:
        at = place[own]
        by = np.argsort(at)
        numbers.append(np.diff(at[by], prepend=0))
        counts.append(c[by])
    head = json.dumps([[d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], [len(c) for c in counts]], separators=(",", ":")).encode()
    raw = len(head).to_bytes(4, "little") + head + _planes(np.concatenate(numbers)) + _planes(np.concatenate(counts))
    return len(raw).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(packed: bytes, pieces: np.ndarray) -> tuple[list, list, np.ndarray]:
    """doc_ids, bytes and token counts, given the pieces of each number."""
    raw = zstandard.ZstdDecompressor().decompress(packed[8:], max_output_size=int.from_bytes(packed[:8], "little"))
    head = 4 + int.from_bytes(raw[:4], "little")
    ids, n_bytes, special, sizes = json.loads(raw[4:head])
    middle = head + (len(raw) - head) // 2
    numbers, counts = _unplanes(raw[head:middle]).astype(np.int64), _unplanes(raw[middle:]).astype(np.int64)
    ends = np.cumsum(np.array(sizes, np.int64))
    starts = ends - sizes
    total = np.cumsum(numbers)
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1], 0) if len(total) else np.zeros(len(sizes), np.int64)
    at = total - np.repeat(before, sizes)
    sums = np.concatenate([[0], np.cumsum(counts * pieces[at])])
    return ids, n_bytes, sums[ends] - sums[starts] + np.array(special, np.int64)


_TYPES = [("block", pa.int64()), ("number", pa.int32()), ("pretoken", pa.binary()), ("pack", pa.binary())]


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES)], [n for n, _ in _TYPES])


def _blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, n = load(tokenizer), TaskContext.get().partitionId(), 0
        block = _Block(bpe)
        for batch in batches:
            for doc_id, n_bytes, text in zip(runtime.values(batch, "doc_id").to_pylist(), runtime.values(batch, "n_bytes").to_pylist(), runtime.texts(batch)):
                block.add(doc_id, n_bytes, text)
                if block.chars >= BLOCK_CHARS or len(block.number) >= BLOCK_NAMES:
                    yield from block.rows(part << 32 | n)
                    block, n = _Block(bpe), n + 1
        if block.docs:
            yield from block.rows(part << 32 | n)
        del block
        runtime.trim()

    return docs.mapInArrow(run, "block bigint, number int, pretoken binary, pack binary")


def _pieces(vocabulary: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last, count = load(tokenizer), None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                tokens = runtime.values(part, "pretoken").to_pylist()
                new = [t for t, before in zip(tokens, [last, *tokens]) if t != before]
                counted = iter(bpe.pieces([t.decode() for t in new]))
                out = []
                for t in tokens:
                    if t != last:
                        last, count = t, next(counted)
                    out.append(count)
                yield pa.RecordBatch.from_arrays([runtime.values(part, "block"), runtime.values(part, "number"), pa.array(out, pa.int32())], ["block", "number", "pieces"])
        runtime.trim()

    # The first numbers of a block are its commonest pre-tokens, which nearly every block has: deal these by some of the blocks, too.
    salt = F.when(F.col("number") < HOT_NUMBERS, F.pmod(F.xxhash64("block"), F.lit(SALTS))).otherwise(0)
    return vocabulary.repartition("pretoken", salt).sortWithinPartitions("pretoken").mapInArrow(run, "block bigint, number int, pieces int")


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    pieces = np.zeros(right.num_rows, np.int64)
    pieces[right.column("number").to_numpy()] = right.column("pieces").to_numpy()
    ids, n_bytes, tokens = [], [], []
    for packed in left.column("pack").to_pylist():
        a, b, c = unpack(packed, pieces)
        ids += a
        n_bytes += b
        tokens.append(c)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(np.concatenate(tokens) if tokens else [], pa.int64())})


def count_tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8) and ``n_tokens`` of each whole text, a row for each input row.

    Special strings inside texts are one token, as the tokenizer's default is. Null and
    empty texts have zeros; repeated rows stay repeated; a null doc_id stays null; other
    columns are ignored; an empty table stays empty.
    """
    runtime.ship(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    blocks = runtime.table(_blocks(docs, tokenizer), "token-blocks")
    pieces = _pieces(blocks.where("pretoken IS NOT NULL").select("block", "number", "pretoken"), tokenizer)
    packs = blocks.where("pack IS NOT NULL").select("block", "pack")
    return packs.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_sums, "doc_id bigint, n_bytes bigint, n_tokens bigint")
