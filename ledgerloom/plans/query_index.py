"""Driver queries: stored indexes of texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import graph, retrieval, sparse_index, vector_index
from ledgerloom.plans.catalog import query, read
from ledgerloom.plans.query_text import _BM
from ledgerloom.streaming import page_state


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def _ready(docs):
    return docs.select("doc", F.sha2("text", 256).alias("hash"), text.tokens(F.col("text")).alias("tokens"))


def _asked(spark, sf_dir):
    return retrieval.token_frequencies(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query"), "query", text.tokens(F.col("text")))


def _ranks(found):
    return found.hits.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@query(_BM + "SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM sr WHERE rank <= 20")
def sparse_index_topk(spark, sf_dir):
    """The best twenty documents of each benchmark text from a stored inverted index."""
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "sparse-index"))
    sparse_index.update(index, _ready(_documents(spark, sf_dir)))
    return _ranks(sparse_index.search(index, _asked(spark, sf_dir), 20, 6))


_NOW = "(SELECT doc_id, CASE WHEN source = 'src2' THEN coalesce(text, '') || ' ' || lang ELSE coalesce(text, '') END AS text FROM documents WHERE source IS DISTINCT FROM 'src1')"


@query(_BM.replace("FROM documents", f"FROM {_NOW}") + "SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM sr WHERE rank <= 20")
def sparse_index_update(spark, sf_dir):
    """The same after an update: documents of one source are new, those of another went, those of a third changed."""
    docs = _documents(spark, sf_dir)
    index = sparse_index.SparseIndex(spark, graph.shared_folder(spark, "sparse-index"))
    sparse_index.update(index, _ready(docs.where(~F.col("source").eqNullSafe("src3"))))
    now = docs.where(~F.col("source").eqNullSafe("src1")).withColumn("text", F.when(F.col("source") == "src2", F.concat_ws(" ", "text", "lang")).otherwise(F.col("text")))
    sparse_index.update(index, _ready(now))
    return _ranks(sparse_index.search(index, _asked(spark, sf_dir), 20, 6))


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE source IS DISTINCT FROM 'src2' AND text IS NOT NULL),
r AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS k, l FROM s),
b AS (SELECT doc_id, k, trim(l[k], E' \\t\\r\\f\\x0b') AS text FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS d FROM b WHERE text <> '')
SELECT doc_id, CASE WHEN d = 1 THEN 'Part' ELSE 'Part (' || d || ')' END AS section, sha256(text) AS text_hash FROM n
""")
def stream_points(spark, sf_dir):
    """The sections that a stream of pages leaves, of which one source is taken back; a header is before each line of a document."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    page = F.concat(F.lit("## Part\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n---\n## Part\n")))
    first = docs.select(F.col("doc_id").cast("string").alias("page_id"), page.alias("markdown"), F.lit(0).alias("version"))
    gone = docs.where("source = 'src2'").select(F.col("doc_id").cast("string").alias("page_id"), F.lit(None).cast("string").alias("markdown"), F.lit(1).alias("version"))
    folder = graph.shared_folder(spark, "page-stream")
    first.unionByName(gone).write.json(f"{folder}/in")  # a file for each task, however many there are
    files = len(spark.read.schema(page_state.PAGES).json(f"{folder}/in").inputFiles())
    page_state.follow(spark, f"{folder}/in", f"{folder}/table", f"{folder}/check", max(1, -(-files // 3))).awaitTermination()
    left = page_state.current(spark.read.schema(page_state.ACTIONS).parquet(f"{folder}/table"))
    return left.select(F.col("page_id").cast("bigint").alias("doc_id"), "section", F.sha2("text", 256).alias("text_hash"))


#: Every twentieth vector is a query.
_VECTORS = """
WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM s)
"""


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query"), "vector")


@query(_VECTORS + "SELECT query, id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 20")
def vector_index_exact(spark, sf_dir):
    """The twenty nearest vectors from a stored index that reads all its lists."""
    v, q = _vectors(spark, sf_dir)
    index = vector_index.build(v, graph.shared_folder(spark, "vector-index"))
    return vector_index.search(index, q, 20, exact=True, digits=6).select("query", "id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT CAST(count(*) AS BIGINT) AS queries, CAST(sum(least(20, (SELECT count(*) FROM embeddings))) AS BIGINT) AS wanted, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the lists that are probed hold 95 % of the exact hits."""
    v, q = _vectors(spark, sf_dir)
    index = vector_index.build(v, graph.shared_folder(spark, "vector-index"))
    exact = vector_index.search(index, q, 20, exact=True, digits=6)
    found = vector_index.recall(vector_index.search(index, q, 20, digits=6), exact)
    return found.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.95 * F.sum("wanted")).alias("enough"))
