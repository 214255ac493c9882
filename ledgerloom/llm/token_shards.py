"""Token-id shards: documents as token ids in wavelet-matrix files, in ascending doc_id order.

The documents are dealt by range of doc_id and sorted, each task encodes its documents
and writes shards of about ``SHARD_TOKENS`` tokens to the shared folder under a name
that a retried task writes again. The manifest is a table with one row for each file;
from it come the places where files begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, runtime, wavelet

#: Tokens of a file, about, and those that one task reads at scale.
SHARD_TOKENS, READ_TOKENS = 1 << 24, 1 << 26
OUT_BYTES = 16_000_000
_MANIFEST = "part int, shard int, path string, documents bigint, tokens bigint"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, append ``end_id`` to each document and write the shards.

    Returns the manifest, a row ``(part, shard, path, documents, tokens, start)`` for each
    file; ``start`` counts the tokens of all files before it. Null and empty texts have
    only the end id; null doc_ids come first; rows that repeat a doc_id follow each other
    in the order of a hash of their text (and may be dealt to several files); an empty
    table writes no file. Only the totals of the partitions, of which the session fixes
    the number, come to the driver.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe.load(tokenizer), TaskContext.get().partitionId()
        ids, keys, lengths, size, shard = [], [], [], 0, 0
        wide = np.uint16 if max(end_id, encoder.most_id) < 65536 else np.uint32

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{shard:05d}.wm"
            runtime.put_file(path, wavelet.dump(np.concatenate(ids), keys, lengths))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "documents": len(keys), "tokens": size}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            doc_ids, at = runtime.values(batch, "doc_id").to_pylist(), 0
            for own, ends in encoder.encode(runtime.values(batch, "text")):
                n = len(ends) - 1
                ids.append(np.insert(own.astype(wide, copy=False), ends[1:], end_id))
                keys += doc_ids[at : at + n]
                lengths += (np.diff(ends) + 1).tolist()
                size, at = size + len(ids[-1]), at + n
                if size >= shard_tokens:
                    yield flush()
                    ids, keys, lengths, size, shard = [], [], [], 0, shard + 1
        if keys:
            yield flush()
        ids.clear()
        runtime.trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "text")
    written = runtime.table(dealt.select("doc_id", "text").mapInArrow(run, _MANIFEST), "shard-manifest")
    starts, start = [], 0
    for part, tokens in sorted(tuple(r) for r in written.groupBy("part").agg(F.sum("tokens")).collect()):
        starts.append((part, start))
        start += tokens
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    in_part = written.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return in_part.join(F.broadcast(spark.createDataFrame(starts, "part int, first bigint")), "part").select("part", "shard", "path", "documents", "tokens", (F.col("first") + F.col("inside")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: ``doc_id, start`` (tokens of all documents before it) and ``ids`` (32-bit little-endian integers)."""
    spark = manifest.sparkSession
    runtime.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(runtime.values(batch, "path").to_pylist(), runtime.values(batch, "start").to_pylist()):
                fs, local = runtime.open_fs(path)
                with fs.open_input_file(local) as f:
                    shard = wavelet.WaveletFile(f)
                    keys, ends = shard.documents()
                    tokens = shard.all()
                ends = ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                first = 0
                while first < len(keys):  # some documents at a time
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + OUT_BYTES // 4, "right")))
                    data = tokens[starts[first] : ends[last - 1]].astype("<u4")
                    offsets = np.append(starts[first:last], ends[last - 1]) - starts[first]
                    ids = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((offsets * 4).astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[first:last], pa.int64()), pa.array(starts[first:last] + before, pa.int64()), ids], ["doc_id", "start", "ids"])
                    first = last

        runtime.trim()

    files, tokens = manifest.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    tasks = max(1, min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (tokens or 0) // READ_TOKENS)))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, ids binary")
