"""Markdown pages, their notes, and writing only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import sync


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``) and ``markdown`` of each ``.md`` file; notes are not pages."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    name = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.regexp_extract("_metadata.file_path", f"/{name}/(.*)$", 1)
    return files.select(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("markdown"))


def with_notes(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages with ``notes`` from ``<path without .md>.notes.md``: LF line ends, trimmed, blank ones null."""
    blank = "[ \\t\\r\\n]+"
    text = F.regexp_replace(F.replace("markdown", F.lit("\r\n"), F.lit("\n")), f"^{blank}|{blank}$", "")
    notes = files.where(F.col("path").endswith(".notes.md")).select(F.regexp_replace("path", "\\.notes\\.md$", ".md").alias("path"), F.when(text != "", text).alias("notes"))
    return pages.where(~F.col("path").endswith(".notes.md")).join(notes, "path", "left")


def write_changed(old: DataFrame, new: DataFrame, folder: str) -> DataFrame:
    """Write new and changed pages (``path, content, hash``) as a Parquet batch and return all actions.

    A page is written when its hash differs from the old one; stale pages are only
    reported as ``delete`` here, for ``sync.stale_paths`` to decide.
    """
    actions = sync.changes(old, new, "path", "hash")
    new.join(actions.where("action IN ('create', 'update')").select("path"), "path", "left_semi").write.mode("append").parquet(folder)
    return actions
