"""Shared helpers: the shared folder, materialised tables, code shipping and Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="ledgerloom-code-")) / "ledgerloom_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A cluster must set it; one machine (a local master, as in tests) gets a temporary
    folder for the life of the application where none is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_dirs.get(sc.applicationId)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-shared-")
            _own_dirs[sc.applicationId] = root
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving all that was written to the shared folder inside; what is to stay must have been read or written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(spark, *_scopes.pop())


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (plain paths are local ones)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under a name of its own, then move it into place, so that a retried task is harmless."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def trim() -> None:
    """Give freed memory back at the end of a task: an idle worker should hold little."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def byte_table(word_bytes: Iterable[int] | None = None) -> np.ndarray:
    """A table for ``words``: A-Z become a-z, and bytes that are not among ``word_bytes`` (beside 128 to 255) become blanks."""
    table = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
    if word_bytes is not None:
        kept = set(word_bytes)
        table[[b for b in range(128) if b not in kept and not 65 <= b <= 90]] = 32
    return table


def parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, as wide as the array's type has them) and bytes of an array of strings or binaries without nulls."""
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    if not (wide or pa.types.is_string(strings.type) or pa.types.is_binary(strings.type)):
        raise TypeError(f"strings are needed, not {strings.type}")
    if not len(strings):
        return np.zeros(1, np.int64 if wide else np.int32), np.zeros(0, np.uint8)
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(strings.buffers()[1], kind, len(strings) + 1, kind.itemsize * strings.offset)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def words(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of some texts, which ASCII white space separates once their bytes went through a table.

    Gives the number of each word, in order, where each text's words begin (and the last
    end), and what the numbers stand for. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if table is not None:
        offsets, data = parts(texts)
        texts = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(table[data])])
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    number = coded.indices.to_numpy()
    real = np.array([bool(n) for n in names], bool)[number]  # white space at an end leaves an empty piece
    offsets = split.offsets.to_numpy()
    return number[real], np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]], names


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Some texts at a time: about ``size`` bytes, or one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as str; null becomes empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def plain(table: pa.Table) -> pa.Table:
    """Texts and binaries of a table with 32-bit offsets, as grouped functions must return them, whatever they were given."""
    to = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    return table.cast(pa.schema([pa.field(f.name, to.get(f.type, f.type)) for f in table.schema]))


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name neither clash nor travel."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def chunks(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
