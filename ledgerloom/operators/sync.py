"""Incremental synchronisation by content hash: what to write, to delete and to leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, action)``: ``create``, ``update``, ``unchanged`` or ``delete``."""
    o, n = old.select(F.col(key), F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "create").when(F.col("_in_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def stale_paths(old: DataFrame, new: DataFrame, root: str) -> DataFrame:
    """Once generated paths that are no longer; only those inside ``root`` (no way out by ``..``)."""
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike("(^|/)\\.\\.(/|$)")
    return old.select("path").where(inside).join(new.select("path"), "path", "left_anti")


def publish_actions(pages: DataFrame, remote: DataFrame, stamp_format: str) -> DataFrame:
    """``(page_id, action)``: ``create`` (no remote page), ``foreign`` (its title is taken by a page that isn't ours), ``unchanged`` (same hash, format and parent) or ``update``.

    ``pages``: ``page_id, title, hash, parent``; ``remote``: ``title, stamp_page_id,
    stamp_hash, stamp_format, parent``.
    """
    r = remote.select("title", "stamp_page_id", "stamp_hash", "stamp_format", F.col("parent").alias("_parent"), F.lit(True).alias("_there"))
    both = pages.join(r, "title", "left")
    same = F.col("stamp_hash").eqNullSafe(F.col("hash")) & F.col("stamp_format").eqNullSafe(F.lit(stamp_format)) & F.col("_parent").eqNullSafe(F.col("parent"))
    action = F.when(F.col("_there").isNull(), "create").when(~F.col("stamp_page_id").eqNullSafe(F.col("page_id")), "foreign").when(same, "unchanged").otherwise("update")
    return both.select("page_id", action.alias("action"))


def page_states(points: DataFrame, pages: DataFrame, signature: Column) -> DataFrame:
    """``(page_id, n_points, current)``: a page is current if it has points and all have its hash and the embedder's signature."""
    p = points.select("page_id", F.col("page_hash").alias("_hash"), "embedder")
    same = F.col("_hash").eqNullSafe(F.col("hash")) & (F.col("embedder") == signature)
    return pages.join(p, "page_id", "left").groupBy("page_id").agg(F.count("embedder").alias("n_points"), F.coalesce(F.bool_and(same), F.lit(False)).alias("current"))


def index_sync(points: DataFrame, pages: DataFrame, chunked: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """``(upserts, deletes)`` of an index.

    ``points``: ``id, page_id, page_hash, embedder``; ``pages``: ``page_id, hash``;
    ``chunked``: ``id, page_id, ...`` of all pages as they are now (lazy: only those of
    pages that are not current are used). Deletes are points of pages that are gone and
    sections of changed pages that are gone.
    """
    current = page_states(points, pages, F.lit(signature)).where("current").select("page_id")
    upserts = chunked.join(current, "page_id", "left_anti")
    orphans = points.join(pages.select("page_id"), "page_id", "left_anti").select("id")
    changed = points.join(pages.select("page_id"), "page_id", "left_semi").join(current, "page_id", "left_anti").select("id")
    return upserts, orphans.unionByName(changed.join(upserts.select("id"), "id", "left_anti"))


def merge(table: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """The table after deletes and upserts."""
    gone = deletes.select(key).unionByName(upserts.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(upserts.select(*table.columns))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def golden_diff(expected: DataFrame, actual: DataFrame, keys: list[str], ignore: Column | None = None) -> DataFrame:
    """``keys, side``: ``missing`` (a failure) or ``extra`` (reported, but for those to ignore)."""
    missing = set_difference(expected, actual, keys).withColumn("side", F.lit("missing"))
    extra = set_difference(actual, expected, keys)
    return missing.unionByName((extra if ignore is None else extra.where(~ignore)).withColumn("side", F.lit("extra")))


def exactly_once(wanted: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """``(key, error)``: wanted keys that no use names (``missing``) or several do (``duplicate``)."""
    n = uses.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = wanted.select(key).distinct().join(n, key, "left")
    return both.select(key, F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").alias("error")).where("error IS NOT NULL")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_cached(cache: DataFrame, statuses: DataFrame, status: str = "needs_review") -> DataFrame:
    """A cache without the entries whose status asks for another try."""
    return cache.join(statuses.where(F.col("status") == status).select("card_hash"), "card_hash", "left_anti")
