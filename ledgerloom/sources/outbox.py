"""Writing to a service in transactions.

Tasks *stage* their rows in batches, under keys made of what is in them, and *seal* the
list of their batches; the commit of the Spark job gives the service the seals of the
tasks that counted, one name each. What a killed task or one that was run twice has
staged beside them is never seen. A transaction is made on a version of what is stored; if
that has moved on meanwhile the commit is refused, and ``transact`` reads anew and makes
the rows again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

from ledgerloom.sources import files
from ledgerloom.sources.sinks import ATTEMPTS, UPSERT_BATCH, with_retry


class Conflict(Exception):
    """What is stored is no longer the version that a transaction was made on."""


class Service(Protocol):
    """What a client offers; it is copied to the executors. Each call may come again with the same arguments."""

    def version(self) -> int:
        """The version of what is stored."""

    def stage(self, transaction: str, key: str, rows: list[dict]) -> None:
        """Keep a batch, not yet to be seen."""

    def seal(self, transaction: str, key: str, batches: list[str]) -> None:
        """Keep the list of a task's batches."""

    def commit(self, transaction: str, base: int, seals: list[str]) -> None:
        """Let all batches of these seals be seen at once, as the version after ``base``; else ``Conflict``."""

    def committed(self, transaction: str) -> bool:
        """Whether a transaction was committed."""

    def abort(self, transaction: str) -> None:
        """Forget what was staged."""


@dataclass
class _Sealed(WriterCommitMessage):
    #: None of a task without rows.
    seal: str | None


def _name(content: object) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()


class _Writer(DataSourceWriter):
    def __init__(self, service: Service, transaction: str, base: int, size: int) -> None:
        self.service, self.transaction, self.base, self.size = service, transaction, base, size

    def write(self, iterator: Iterator[Row]) -> _Sealed:
        held: list[dict] = []
        batches: list[str] = []

        def stage() -> None:
            batches.append(_name(held))
            with_retry(self.service.stage, self.transaction, batches[-1], held)

        for row in iterator:
            held.append(row.asDict(recursive=True))
            if len(held) == self.size:
                stage()
                held = []
        if held:
            stage()
        if not batches:
            return _Sealed(None)
        seal = _name(batches)
        with_retry(self.service.seal, self.transaction, seal, batches)
        return _Sealed(seal)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with_retry(self.service.commit, self.transaction, self.base, sorted(m.seal for m in messages if m and m.seal))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with_retry(self.service.abort, self.transaction)


def write(df: DataFrame, service: Service, base: int, key: str, size: int = UPSERT_BATCH) -> str:
    """Write rows as one transaction on version ``base``; its name. Two rows of one ``key`` are an error."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    transaction = uuid.uuid4().hex

    class Outbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return "outbox"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(service, transaction, base, size)

    df.sparkSession.dataSource.register(Outbox)
    try:
        df.sortWithinPartitions(key).write.format("outbox").mode("append").save()
    except Exception as error:
        if service.committed(transaction):  # only the answer was lost
            return transaction
        if service.version() != base:
            raise Conflict(f"version {service.version()} is stored, {base} was read") from error
        raise
    return transaction


def transact(make: Callable[[int], DataFrame], service: Service, key: str, size: int = UPSERT_BATCH, attempts: int = ATTEMPTS) -> str:
    """Write what ``make(version)`` gives for the version that is stored; read and make anew where that moved on meanwhile."""
    for attempt in range(1, attempts + 1):
        base = service.version()
        try:
            return write(make(base), service, base, key, size)
        except Conflict:
            if attempt == attempts:
                raise
    raise AssertionError("unreachable")


class FolderService:
    """A service in a folder: batches as JSON files, a commit as the one file of its number.

    The file system must be able to create a file only where there is none (local ones can).
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in files.names(f"{self.folder}/commits")), default=0)

    def stage(self, transaction: str, key: str, rows: list[dict]) -> None:
        files.put(f"{self.folder}/staged/{transaction}/{key}.json", "\n".join(json.dumps(r, default=str) for r in rows).encode())

    def seal(self, transaction: str, key: str, batches: list[str]) -> None:
        files.put(f"{self.folder}/seals/{transaction}/{key}.json", "\n".join(json.dumps({"path": f"{transaction}/{b}.json"}) for b in batches).encode())

    def commit(self, transaction: str, base: int, seals: list[str]) -> None:
        what = json.dumps({"transaction": transaction, "version": base + 1, "seals": [f"{transaction}/{s}.json" for s in seals]})
        if self.version() != base or not files.create(f"{self.folder}/commits/{base + 1:08d}.json", what.encode()):
            if not self.committed(transaction):
                raise Conflict(transaction)

    def committed(self, transaction: str) -> bool:
        return any(json.loads(files.read(f"{self.folder}/commits/{n}") or b"{}").get("transaction") == transaction for n in reversed(files.names(f"{self.folder}/commits")))

    def abort(self, transaction: str) -> None:
        for kind in ("staged", "seals"):
            files.remove_folder(f"{self.folder}/{kind}/{transaction}")

    def read(self, spark: SparkSession, schema: str, key: str, version: int | None = None, deleted: str = "deleted") -> DataFrame:
        """The rows of a version: of each key what was committed last, but for those whose column ``deleted`` is true."""
        kind = _parse_datatype_string(schema)
        version = self.version() if version is None else version
        if not version:
            return spark.createDataFrame([], kind)
        end = lambda c: F.substring_index(c, "/", -2)
        commits = spark.read.schema("transaction string, version int, seals array<string>").json(f"{self.folder}/commits").where(F.col("version") <= version)
        sealed = commits.select("version", F.explode("seals").alias("seal"))
        batches = spark.read.schema("path string").json(f"{self.folder}/seals/*").select(end(F.col("_metadata.file_path")).alias("seal"), "path")
        rows = spark.read.schema(kind).json(f"{self.folder}/staged/*").withColumn("path", end(F.col("_metadata.file_path")))
        seen = rows.join(batches.join(sealed, "seal"), "path")
        last = seen.groupBy(key).agg(F.max_by(F.struct(*kind.names), "version").alias("row")).select("row.*")
        return last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted in kind.names else last
