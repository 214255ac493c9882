"""Driver queries: tables read from a paged service, and written to one in transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.plans.catalog import query, read
from ledgerloom.sources import outbox, paged

_PAGES = "page_id bigint, url string, html string"


def _service(sf_dir):
    return paged.TableService(f"{sf_dir}/pages.parquet", "page_id", _PAGES, taken=("url",))


@query("SELECT page_id, url, CAST(length(html) AS INT) AS n FROM pages")
def paged_read(spark, sf_dir):
    """All pages, read from a service by pages of 256 rows."""
    return paged.read(spark, _service(sf_dir)).select("page_id", "url", F.length("html").alias("n"))


@query("SELECT page_id, CAST(length(html) AS INT) AS n FROM pages WHERE page_id > 10 AND page_id <= 140 AND length(html) > 500 AND url IS NOT NULL")
def paged_filter(spark, sf_dir):
    """Conditions on the key narrow what is asked for; others are judged here."""
    p = paged.read(spark, _service(sf_dir), partitions=3)
    return p.where("page_id > 10 AND page_id <= 140 AND length(html) > 500 AND url IS NOT NULL").select("page_id", F.length("html").alias("n"))


_POINT = "doc_id bigint, hash string, deleted boolean"


@query("SELECT doc_id, sha256(CASE WHEN source = 'src2' THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS hash FROM documents WHERE source IS DISTINCT FROM 'src1'")
def outbox_points(spark, sf_dir):
    """Documents written as points in two transactions, of which the second changes some and deletes others, and read back."""
    docs = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    service = outbox.FolderService(graph.shared_folder(spark, "points"))
    hashed = lambda text: F.sha2(text, 256).alias("hash")
    outbox.transact(lambda _: docs.select("doc_id", hashed(F.col("text")), F.lit(False).alias("deleted")), service, "doc_id")

    def second(version):
        now = docs.where("source IN ('src1', 'src2')").select("doc_id", hashed(F.concat("text", F.lit("!"))), (F.col("source") == "src1").alias("deleted"))
        before = service.read(spark, _POINT, "doc_id", version).select("doc_id", F.col("hash").alias("old"))
        return now.join(before, "doc_id").where("hash <> old").drop("old")

    outbox.transact(second, service, "doc_id")
    return service.read(spark, _POINT, "doc_id").select("doc_id", "hash")
