"""From raw documents to token digests in five stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and works on
all documents that the stage before it kept. Between stages the documents are written
as Parquet to the shared folder and read again.

Every stage but the last takes and returns the columns of ``documents``; further columns,
of any name, are left out. A null text has no words, lines or shingles and stays, as do
empty ones; rows with a null doc_id stay each for itself; an empty table gives an empty
one. Rows that repeat a doc_id and text are one after near dedup; texts that share a
doc_id are judged each for itself. Ties are settled by doc_id, then by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, line_dedup, near_dedup, queries, runtime, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    labels = queries.category_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    chain = toxicity.train(docs, labels, queries.CATEGORIES)
    scored = toxicity.score(docs.select(*COLUMNS), chain)
    return scored.where(F.col("probabilities")[len(queries.CATEGORIES) - 1] < chain.threshold).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of lines go, and documents that lose all their text."""
    out = line_dedup.dedup_lines(docs, carry=["lang", "source", "n_chars"])
    lost = F.size("removed") > 0
    n_chars = F.when(lost, F.char_length("text").cast("bigint")).otherwise(F.col("carried.n_chars"))
    out = out.where(~(lost & (F.trim(F.col("text"), F.lit(" \t\r\n")) == "")))
    return out.select("doc_id", "text", "carried.lang", "carried.source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (five-word shingles, 0.8) stays; rows that repeat one in id and text are one."""
    return near_dedup.without_near_copies(docs.select(*COLUMNS), near_dedup.Likeness(shingle=5, per_cent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % of the words or more are in benchmark windows go."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    bad = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_version"))
    return docs.select(*COLUMNS).join(bad, same, "left_anti")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left; digests of both."""
    return queries.bpe_digest(bpe.encode_decode(docs, queries.tokenizer("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: Training a classifier, MinHash components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = runtime.shared_path(spark, f"pipeline-{name}")
        with runtime.scope(spark):  # what a stage wrote on its way goes with it
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            runtime.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
