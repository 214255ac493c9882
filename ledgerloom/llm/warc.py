"""WARC archives as a Python data source (``format("warc")``), for reading and writing.

Reading plans partitions of whole files (small ones together), takes predicates on the
record type and other header columns into the scan, parses a record's headers first
and passes over the payload of records that are not wanted, or of all when the given
schema has no ``payload``. Compressed archives hold a gzip member for each record; ours
carry its length in the member's extra field ``sl``, so that passing over a record
inflates nothing but its headers. Archives of other writers, compressed or not, with
any number of records in a member, are read too; members without a length are inflated
to find their end. Damaged archives are errors, not shorter results.

Writing makes archives of about ``ARCHIVE_BYTES`` under names of their own for each
attempt; a manifest written at commit names those that count, so a lost task's files
are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ledgerloom.llm import runtime

ARCHIVE_BYTES, PARTITION_BYTES, BATCH_BYTES = 64_000_000, 64_000_000, 16_000_000
LEVEL = 4
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, headers map<string,string>, payload binary"
#: Columns taken from headers, and so known before a payload is touched.
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_MANIFEST = "_manifest"
_END = b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(record_id: str, record_type: str, uri: str | None, digest: str, length: int, refers_to: str | None, payload: bytes) -> bytes:
    """A response record, or a revisit record without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    """A gzip member with its own length in the extra field ``sl``."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    fits = size < 1 << 32
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", size if fits else 0, len(data) if fits else 0) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Window:
    """Random reads of a file through a buffer."""

    def __init__(self, f) -> None:
        self.f, self.size, self.start, self.data = f, f.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.data):
            self.f.seek(at)
            self.start, self.data = at, self.f.read(max(n, 1 << 20))
        return self.data[at - self.start : at - self.start + n]


class Damaged(ValueError):
    """An archive that ends too early, or whose content is not what its checks say."""


class _Plain:
    """The bytes of an uncompressed archive."""

    def __init__(self, window: _Window) -> None:
        self.window, self.at = window, 0

    def more(self, n: int) -> bytes:
        """The next bytes, at most n; none at the end."""
        out = self.window.read(self.at, n)
        self.at += len(out)
        return out

    def over(self, n: int, record: int) -> bool:
        """Pass over the next n bytes, which end a record of that many."""
        self.at += n
        return self.at <= self.window.size


class _Members:
    """The inflated bytes of a compressed archive, member after member, with their checks."""

    def __init__(self, window: _Window) -> None:
        self.window, self.at, self.inflate, self.seen = window, 0, None, b""
        self._open()

    def _open(self) -> None:
        """Read the header of the member that begins here, if there is one."""
        self.start, self.inflate = self.at, None
        head = self.window.read(self.at, 1 << 16)
        if not head.strip(b"\0"):  # the end, or padding
            self.at += len(head)
            return self._open() if head else None
        if head[:3] != b"\x1f\x8b\x08":
            raise Damaged(f"no gzip member at byte {self.at}")
        flags, place, self.length, self.size = head[3] if len(head) > 3 else 0, 10, 0, 0
        if flags & 4:
            extra = int.from_bytes(head[10:12], "little")
            if len(head) < 12 + extra:
                raise Damaged(f"the member at byte {self.at} has no end")
            field = 12
            while field + 4 <= 12 + extra:
                size = int.from_bytes(head[field + 2 : field + 4], "little")
                if head[field : field + 2] == b"sl" and size == 8:
                    self.length, self.size = struct.unpack("<II", head[field + 4 : field + 12])
                field += 4 + size
            place = 12 + extra
        for flag in (8, 16):
            if flags & flag:
                place = head.find(b"\0", place) + 1 or len(head)
        self.at += place + (2 if flags & 2 else 0)
        self.inflate, self.crc, self.given = zlib.decompressobj(-15), 0, 0

    def more(self, n: int) -> bytes:
        while self.inflate is not None:
            if self.inflate.eof:
                self._close()
                continue
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.window.read(self.at, 1 << 16)
                self.at += len(data)
                if not data:
                    raise Damaged(f"the member at byte {self.start} has no end")
            try:
                out = self.inflate.decompress(data, n)
            except zlib.error as error:
                raise Damaged(f"the member at byte {self.start} can't be inflated: {error}") from None
            self.crc, self.given = zlib.crc32(out, self.crc), self.given + len(out)
            if out:
                return out
        return b""

    def _close(self) -> None:
        """Compare the end of a member with what was inflated, and go on to the next."""
        self.at -= len(self.inflate.unused_data)
        if self.window.read(self.at, 8) != struct.pack("<II", self.crc, self.given & 0xFFFFFFFF):
            raise Damaged(f"the member at byte {self.start} is not what its checksum says")
        self.at += 8
        self._open()

    def over(self, n: int, record: int) -> bool:
        """Pass over the next n bytes; without inflating them if the member says that it holds this record alone."""
        if n and self.inflate is not None and self.length and self.size == record:
            self.at = self.start + self.length
            if self.at > self.window.size:
                raise Damaged(f"the member at byte {self.start} has no end")
            self._open()
            return True
        while n > 0:
            out = self.more(min(n, 1 << 20))
            if not out:
                return False
            n -= len(out)
        return True


class _Reader:
    """Reads the records of a stream: bytes that were looked at stay until they are taken."""

    def __init__(self, f) -> None:
        window = _Window(f)
        self.source = _Members(window) if window.read(0, 2) == b"\x1f\x8b" else _Plain(window)
        self.held, self.taken = b"", 0  # taken: bytes since the record began

    def find(self, mark: bytes, limit: int | None = None) -> int:
        """Where a mark is in what comes next (in the first ``limit`` bytes); -1 if it is not."""
        at = 0
        while True:
            found = self.held.find(mark, at, limit)
            if found >= 0 or limit is not None and len(self.held) >= limit:
                return found
            at = max(0, len(self.held) - len(mark) + 1)
            got = self.source.more(1 << 14)
            if not got:
                return -1
            self.held += got

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer at the end."""
        parts, size = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while size < n and (got := self.source.more(min(n - size, 1 << 20))):
            parts.append(got)
            size += len(got)
        self.taken += size
        return b"".join(parts)

    def lines(self) -> bool:
        """Pass over line ends between records; whether anything follows."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                self.taken = 0
                return True
            self.held = self.source.more(1 << 14)
            if not self.held:
                return False

    def over(self, n: int) -> None:
        """Pass over the rest of a record, its two line ends included."""
        rest = n + len(_END) - len(self.held)
        if rest <= 0:
            self.held = self.held[n:]
            return
        record = self.taken + n + len(_END)
        self.held = b""
        if not self.source.over(max(0, rest - len(_END)), record):
            raise Damaged("the last record has no end")


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by their lower-case names, without white space around; of a repeated name the first."""
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _columns(h: dict[str, str]) -> dict[str, str | None]:
    row = {c: h.get(name) for c, name in _HEADER.items()}
    for c in ("record_id", "refers_to"):
        if row[c] is not None:
            row[c] = row[c].removeprefix("<").removesuffix(">")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha256:")
    return row


def _digests_differ(said: str, payload: bytes) -> bool:
    """Whether a digest header (SHA-1, SHA-256 or MD5, in hex or base 32) is of another payload; other forms are not judged."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5") or not value:
        return False
    own = hashlib.new(kind.lower(), payload).digest()
    return value.lower() not in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().rstrip("=").lower())


def records(f, want=lambda row: True, payload: bool = True) -> Iterator[dict]:
    """The wanted records of an archive; ``want`` sees the header columns only.

    An archive may hold one record in each gzip member, several, or parts of one. What is
    read is checked: a missing end, a bad checksum of a member, a length that is not
    there and a payload that is not what its digest says raise ``Damaged``, as what
    would be lost or changed can't be told. (The digest of a payload in a transfer
    encoding is not judged.) What is passed over without inflating it is not checked.
    """
    reader = _Reader(f)
    while reader.lines():
        end = reader.find(_END)
        if end < 0 or not reader.held.startswith(b"WARC/"):
            raise Damaged("there is no WARC record where one should begin" if end >= 0 else "the headers of the last record have no end")
        h = _headers(reader.take(end + len(_END))[:end])
        try:
            size = int(h["content-length"])
        except (KeyError, ValueError):
            raise Damaged("a record has no length") from None
        row, left = _columns(h), size
        if want(row):
            row |= {"headers": h, "payload_bytes": size, "payload": None}
            http: dict[str, str] = {}
            if h.get("content-type", "").startswith("application/http") and (stop := reader.find(_END, size)) >= 0:
                http = _headers(reader.take(stop + len(_END))[:stop])
                left -= stop + len(_END)
                row["payload_bytes"] = left
            if h.get("warc-type") == "revisit":
                if http.get("content-length", "").isdecimal():
                    row["payload_bytes"] = int(http["content-length"])
            elif payload:
                body = reader.take(left)
                if len(body) < left:
                    raise Damaged("the last record has no end")
                left = 0
                if "transfer-encoding" not in http and _digests_differ(h.get("warc-payload-digest", ""), body):
                    raise Damaged(f"the payload of {row['record_id']} is not what its digest says")
                row["payload"] = body
            yield row
        reader.over(left)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema) -> None:
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _HEADER and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        fs, path = runtime.open_fs(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
            listed = [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.startswith(_MANIFEST)]
            if listed:
                names: set[str] = set()
                for x in listed:
                    with fs.open_input_stream(x.path) as f:
                        names |= set(json.loads(f.read()))
                found = [x for x in found if x.base_name in names]
        out, some, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if some and size + x.size > PARTITION_BYTES:
                out.append(_Files(some))
                some, size = [], 0
            some.append(x.path)
            size += x.size
        return [*out, _Files(some)]

    def _want(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = value is None
            elif isinstance(f, IsNotNull):
                ok = value is not None
            elif isinstance(f, EqualNullSafe):
                ok = value == f.value
            elif value is None:
                ok = False
            elif isinstance(f, In):
                ok = value in f.value
            elif isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, StringStartsWith):
                ok = value.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                ok = value.endswith(f.value)
            else:
                ok = f.value in value
            if not ok:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, (fs, _) = to_arrow_schema(self.schema), runtime.open_fs(self.path)
        names = schema.names
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                try:
                    for row in records(f, self._want, "payload" in names):
                        rows.append({k: row[k] for k in names})
                        size += 500 + len(row["payload"] or b"")
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                except Damaged as error:
                    raise Damaged(f"{path}: {error}") from None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Takes the columns record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        names, parts, size = [], [], 0
        attempt = uuid.uuid4().hex

        def flush() -> None:
            name = f"{attempt}-{len(names):05d}.warc.gz"
            runtime.put_file(f"{self.path}/{name}", b"".join(parts))
            names.append(name)

        for batch in iterator:
            for r in batch.to_pylist():
                parts.append(member(record(r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"] or b"")))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    flush()
                    parts, size = [], 0
        if parts:
            flush()
        return _Written(names)

    def commit(self, messages) -> None:
        runtime.put_file(f"{self.path}/{_MANIFEST}-{uuid.uuid4().hex}.json", json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages) -> None:
        fs, path = runtime.open_fs(self.path)
        for m in messages:
            for n in m.names if m else ():
                fs.delete_file(f"{path}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    """Make the source known to a session; turns on the session's push-down into Python sources."""
    runtime.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, folder: str, least: int = 100) -> None:
    """Write a record for each row of ``pages`` (``page_id, url, html``).

    Of rows with equal payloads of ``least`` bytes or more, those with the smallest
    page_id are responses and the others revisit that page. Null html is an empty
    payload. A null page_id never counts as smallest unless all are null; then, and for
    payloads below ``least``, each row is a response. Other columns are ignored; an
    empty table writes an empty manifest.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    both = rows.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    both.select(
        F.coalesce(F.concat(F.lit("urn:page:"), F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        "payload_bytes",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", folder).save()


def read_archives(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The records of the archives in a folder; leave ``payload`` out of ``schema`` to skip payloads."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(folder)
