"""Writing beyond tables: single documents, page files, batches to a service, publishing.

What talks to a service is a function that the caller gives; it runs in Python workers on
partitions, or on the driver where that is said. Deciding what to do stays a DataFrame.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import graph, sync
from ledgerloom.sources import files

#: Sizes of batches, attempts, and the longest pause in seconds (fixed values of the service protocol).
UPSERT_BATCH, DELETE_BATCH, ATTEMPTS, LONGEST_PAUSE = 64, 256, 4, 60.0


def put(path: str, content: str) -> None:
    """Write a whole file (a path or a URI) in one step."""
    files.put(path, content.encode())


def write_if_changed(path: str, content: str) -> bool:
    """Write a file only where its content differs; whether it was written."""
    if files.read(path) == content.encode():
        return False
    put(path, content)
    return True


def write_json(df: DataFrame, path: str) -> bool:
    """A bounded table as one JSON document (an array of objects), written if it differs."""
    rows = df.agg(F.coalesce(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))), F.lit("[]")).alias("j")).first().j
    return write_if_changed(path, rows + "\n")


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """Write page files (``path, content``) below a folder that all executors share; ``(path, written)``.

    A path that is absolute, null or leads out of the folder is an error, before anything is written.
    """
    outside = F.col("path").isNull() | F.col("path").startswith("/") | (F.col("path") == "") | F.col("path").rlike("(^|/)\\.\\.(/|$)")
    bad = [r.path for r in pages.where(outside).select("path").limit(5).collect()]
    if bad:
        raise ValueError(f"paths outside the folder: {bad}")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "written": [write_if_changed(f"{root.rstrip('/')}/{p}", c) for p, c in zip(pdf["path"], pdf["content"])]})

    return graph.cut(pages.select("path", "content").mapInPandas(run, "path string, written boolean"))  # written once


def delete_stale(old: DataFrame, new: DataFrame, root: str) -> list[str]:
    """Delete files of the old manifest (``path``) that the new one lacks, only inside ``root``; those deleted."""
    gone = []
    prefixed = lambda df: df.select(F.concat(F.lit("out/"), "path").alias("path"))
    for row in sync.stale_paths(prefixed(old), prefixed(new), "out").toLocalIterator():
        path = row.path.removeprefix("out/")
        if files.inside(path) and files.remove(f"{root.rstrip('/')}/{path}"):
            gone.append(path)
    return sorted(gone)


class Refused(Exception):
    """A service's refusal: its status, and the pause that it asks for."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def with_retry(call: Callable, *args, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """Call again after status 429 or 5xx: as long after as asked for, else 2, 4, 8 ... seconds, at most a minute."""
    for attempt in range(1, attempts + 1):
        try:
            return call(*args)
        except Refused as error:
            if attempt == attempts or not (error.status == 429 or error.status >= 500):
                raise
            sleep(min(LONGEST_PAUSE, error.retry_after if error.retry_after is not None else 2.0**attempt))


def send_batches(df: DataFrame, size: int, send: Callable[[list[dict]], None]) -> int:
    """Send rows in batches of ``size`` from each partition, with retries; the number of rows sent."""

    def run(batches):
        import pandas as pd

        held: list[dict] = []
        for pdf in batches:
            held += pdf.to_dict("records")
            while len(held) >= size:
                with_retry(send, held[:size])
                yield pd.DataFrame({"n": [size]})
                held = held[size:]
        if held:
            with_retry(send, held)
            yield pd.DataFrame({"n": [len(held)]})

    return df.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def sync_points(points: DataFrame, pages: DataFrame, chunked: DataFrame, signature: str, ensure: Callable[[], None], upsert: Callable[[list[dict]], None], delete: Callable[[list[dict]], None]) -> tuple[int, int]:
    """Bring a point store up to date: ``ensure`` its collection, delete, then upsert; the numbers of points (upserted, deleted)."""
    ensure()
    up, gone = sync.index_sync(points, pages, chunked, signature)
    return send_batches(up, UPSERT_BATCH, upsert), send_batches(gone, DELETE_BATCH, delete)


def orphans(remote: DataFrame, pages: DataFrame) -> DataFrame:
    """Remote pages that carry our label (``title, labelled``) but whose title no page has; they are reported, never deleted."""
    return remote.where("labelled").select("title").join(pages.select("title"), "title", "left_anti")


def parents_first(pages: DataFrame) -> DataFrame:
    """Pages with ``depth``: a page comes after its parent; a cycle ends at the number of pages."""
    deep = graph.depths(pages.select(F.col("page_id").alias("id"), F.col("parent_page_id").alias("parent")))
    return pages.join(deep.withColumnRenamed("id", "page_id"), "page_id")


def publish(pages: DataFrame, remote: DataFrame, stamp_format: str, client, dry_run: bool = False) -> dict[str, int]:
    """Create and update pages (``page_id, title, content, hash, parent_page_id``) by level, parents first; counts by action.

    ``client.create(page, parent_id) -> id`` and ``client.update(page, remote_id, version,
    parent_id)`` run on the driver, as each level needs the ids of the one above; a page
    whose title belongs to somebody else is an error. A dry run converts all pages and
    counts them as created.
    """
    if dry_run:
        return {"create": pages.where(F.col("content").isNotNull()).count(), "update": 0, "unchanged": 0, "foreign": 0}
    named = pages.withColumnRenamed("parent_page_id", "parent")
    actions = sync.publish_actions(named, remote, stamp_format)
    counts = {r.action: r.n for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("foreign"):
        raise ValueError("titles of foreign pages: " + ", ".join(r.title for r in named.join(actions.where("action = 'foreign'"), "page_id").select("title").orderBy("title").limit(20).collect()))
    ids: dict[str, str] = {}
    work = parents_first(pages).join(actions, "page_id").join(remote.select("title", "remote_id", "version"), "title", "left").orderBy("depth", "page_id")
    for row in work.toLocalIterator():
        up = ids.get(row.parent_page_id)
        if row.action == "create":
            ids[row.page_id] = with_retry(client.create, row.asDict(), up)
        else:
            ids[row.page_id] = row.remote_id
            if row.action == "update":
                with_retry(client.update, row.asDict(), row.remote_id, row.version + 1, up)
    return {a: counts.get(a, 0) for a in ("create", "update", "unchanged", "foreign")}
