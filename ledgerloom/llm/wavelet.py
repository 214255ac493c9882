"""A wavelet matrix in a compressed file: token access, counting and occurrence lookup.

File: ``LLWM``, version, header length (all little-endian), a JSON header, then
sections. For each bit of a token, from the highest, the matrix has a plane with that
bit of every token; tokens with a 0 go first in the next plane, in order. A plane is
cut into blocks of ``BLOCK`` bytes, each deflated on its own where that helps, with
the number of ones before each block in the header section. So one token, a count or
the place of an occurrence needs one block of each plane. A documents section holds
the ids and ends of the documents.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC, VERSION, BLOCK = b"LLWM", 1, 8192


def _deflate(raw: bytes) -> bytes:
    out = zstandard.ZstdCompressor(level=1).compress(raw)
    return out if len(out) < len(raw) else raw


def _inflate(data: bytes, size: int) -> bytes:
    return data if len(data) == size else zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def dump(tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: its tokens in order, and its documents."""
    n = len(tokens)
    bits = max(1, int(tokens.max()).bit_length()) if n else 1
    current = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    compress = zstandard.ZstdCompressor(level=1)
    body, planes, at = [], [], 0
    for level in range(bits - 1, -1, -1):
        ones = (current & current.dtype.type(1 << level)) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        before, sizes, count = [], [], 0
        for i in range(0, len(packed), BLOCK):
            raw = packed[i : i + BLOCK]
            out = compress.compress(raw)
            out = out if len(out) < len(raw) else raw
            before.append(count)
            sizes.append(len(out))
            count += int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
            body.append(out)
        planes.append({"at": at, "zeros": n - count, "sizes": sizes, "ones": before})
        at += sum(sizes)
        current = np.concatenate([current[~ones], current[ones]])
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    ends = np.cumsum(np.array(lengths, "<u8"), dtype="<u8").tobytes()
    sections = {}
    for name, raw in (("docs", docs), ("nulls", nulls), ("ends", ends)):
        out = _deflate(raw)
        sections[name] = [at, len(out), len(raw)]
        body.append(out)
        at += len(out)
    header = json.dumps({"tokens": n, "bits": bits, "documents": len(lengths), "planes": planes, "sections": sections}, separators=(",", ":")).encode()
    packed_header = zstandard.ZstdCompressor(level=3).compress(header)
    return b"".join([MAGIC, struct.pack("<HII", VERSION, len(packed_header), len(header)), packed_header, *body])


class WaveletFile:
    """Reads a shard from a seekable file; only the blocks that are asked for are read and inflated."""

    def __init__(self, source) -> None:
        self.source = source
        head = source.read(14)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        version, packed, size = struct.unpack("<HII", head[4:14])
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        self.header = json.loads(zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size))
        self.start = 14 + packed
        self.tokens, self.bits = self.header["tokens"], self.header["bits"]
        for plane in self.header["planes"]:
            plane["offsets"] = [plane["at"], *(plane["at"] + np.cumsum(plane["sizes"])).tolist()]
        self._block = lru_cache(maxsize=256)(self._load)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(self.start + at)
        return self.source.read(size)

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, packed, size = self.header["sections"][name]
        return np.frombuffer(_inflate(self._read(at, packed), size), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids and ends (in tokens) of the documents."""
        ids, nulls = self._section("docs", "<i8").tolist(), self._section("nulls", np.uint8)
        return [None if z else d for d, z in zip(ids, nulls)], self._section("ends", "<u8")

    def _plane_bytes(self) -> int:
        return (self.tokens + 7) // 8

    def _load(self, level: int, block: int) -> np.ndarray:
        plane = self.header["planes"][level]
        size = min(BLOCK, self._plane_bytes() - block * BLOCK)
        return np.frombuffer(_inflate(self._read(plane["offsets"][block], plane["sizes"][block]), size), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        block, byte = divmod(i >> 3, BLOCK)
        return int(self._block(level, block)[byte]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.tokens:
            return self.tokens - self.header["planes"][level]["zeros"]
        block, byte = divmod(i >> 3, BLOCK)
        data = self._block(level, block)
        inside = int(np.bitwise_count(data[:byte]).sum()) + (int(data[byte]) & ((1 << (i & 7)) - 1)).bit_count()
        return self.header["planes"][level]["ones"][block] + inside

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones, n = self.header["planes"][level]["ones"], self._plane_bytes() * 8
        low, high = 0, len(ones)
        while high - low > 1:  # the last block with at most k such bits before it
            middle = (low + high) // 2
            before = ones[middle] if bit else middle * BLOCK * 8 - ones[middle]
            low, high = (middle, high) if before <= k else (low, middle)
        before = ones[low] if bit else low * BLOCK * 8 - ones[low]
        flags = np.unpackbits(self._block(level, low), bitorder="little")[: min(n, self.tokens) - low * BLOCK * 8]
        return low * BLOCK * 8 + int(np.flatnonzero(flags == bit)[k - before])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for level, plane in enumerate(self.header["planes"]):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = plane["zeros"] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level, plane in enumerate(self.header["planes"]):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (plane["zeros"] + a, plane["zeros"] + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token is in places low to high."""
        high = self.tokens if high is None else high
        if token < 0 or token >> self.bits or low >= high:
            return 0
        a, b = self._range(token, low, high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, 0, self.tokens)[0] + k
        for level in range(self.bits - 1, -1, -1):
            zeros = self.header["planes"][level]["zeros"]
            place = self._select(level, 1, place - zeros) if token >> (self.bits - 1 - level) & 1 else self._select(level, 0, place)
        return place

    def all(self) -> np.ndarray:
        """All tokens, by undoing the planes from the last to the first."""
        current = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = self.header["planes"][level]
            packed = self._read(plane["at"], sum(plane["sizes"]))
            raw, at = [], 0
            for block, size in enumerate(plane["sizes"]):
                raw.append(_inflate(packed[at : at + size], min(BLOCK, self._plane_bytes() - block * BLOCK)))
                at += size
            ones = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), count=self.tokens, bitorder="little").astype(bool) if self.tokens else np.zeros(0, bool)
            above = np.empty_like(current)
            above[~ones] = current[: plane["zeros"]]
            above[ones] = current[plane["zeros"] :] | current.dtype.type(1 << (self.bits - 1 - level))
            current = above
        return current
