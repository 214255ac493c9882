"""An index that follows a stream of pages: each micro-batch writes what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import text
from ledgerloom.operators import retrieval

_COLUMNS = "id string, page_id string, section string, text string, page_hash string, embedder string, version bigint, batch bigint"


def points_of(pages: DataFrame, signature: str) -> DataFrame:
    """``id, page_id, section, text, page_hash, embedder, version`` of the sections of ``page_id, markdown, version``; a page without sections is one row with no ``id``."""
    hashed = pages.withColumn("page_hash", F.sha2("markdown", 256))
    cut = retrieval.sections(hashed, "page_id", "markdown")
    both = hashed.select("page_id", "page_hash", "version").join(cut, "page_id", "left")
    id_ = F.when(F.col("section").isNotNull(), text.point_id(F.col("page_id"), F.col("section")))
    return both.select(id_.alias("id"), "page_id", "section", "text", "page_hash", F.lit(signature).alias("embedder"), "version")


def follow(spark: SparkSession, source: str, table: str, checkpoint: str, signature: str = "offline-hash:64") -> StreamingQuery:
    """Read page files (JSON lines of ``page_id, markdown, version``) as they come and write their points to a Parquet table, a partition for each batch.

    A batch keeps the newest version of each page and leaves out those that earlier
    batches have as newest with the same hash. A batch that is run again overwrites its own
    partition and does not look at it, so one that died half-way leaves nothing behind.
    """
    stream = spark.readStream.schema("page_id string, markdown string, version bigint").json(source)

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("page_id").agg(F.max(F.struct("version", "markdown")).alias("p")).select("page_id", "p.markdown", "p.version")
        before = read(spark, table).where(F.col("batch") < number)
        known = before.groupBy("page_id").agg(F.max(F.struct("version", "batch", "page_hash")).alias("k")).select("page_id", F.col("k.page_hash").alias("_hash"))
        newest = newest.join(known, "page_id", "left").where(~F.sha2("markdown", 256).eqNullSafe(F.col("_hash"))).drop("_hash")
        points_of(newest, signature).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table with its batches; empty before the first."""
    try:
        return spark.read.schema(_COLUMNS).option("basePath", table).parquet(table)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _COLUMNS)


def current(points: DataFrame) -> DataFrame:
    """The points of the newest version of each page (of the newest batch that has it); pages whose newest version has no sections have none."""
    newest = points.groupBy("page_id").agg(F.max(F.struct("version", "batch")).alias("_newest"))
    return points.join(newest, "page_id").where((F.struct("version", "batch") == F.col("_newest")) & F.col("id").isNotNull()).drop("_newest")
