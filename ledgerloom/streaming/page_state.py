"""An index kept in step with a stream of pages by state: what to write and what to delete.

The state of a page is its newest version, the hash of its text and the ids of its
sections. A version that is not newer is passed over; one with the same hash changes
nothing; of any other the sections are written and those that are no longer there are
deleted; a page without text is deleted. A batch reads nothing but its own pages, and
however the stream is cut into batches the points that are left are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import text
from ledgerloom.operators import retrieval

#: The store that keyed state with several fields needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGES = "page_id string, markdown string, version bigint"
ACTIONS = "action string, id string, page_id string, section string, text string, page_hash string, version bigint"


class PageState(StatefulProcessor):
    """Turns versions of a page into upserts and deletes of its sections."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "version bigint, hash string, ids array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            for version, hash_, points in zip(pdf["version"], pdf["page_hash"], pdf["points"]):
                # Two texts of one version: the greater hash, so that order plays no part; none is the least.
                if newest is None or (version, hash_ or "") > (newest[0], newest[1] or ""):
                    newest = version, hash_, points
        if newest is None:
            return
        version, hash_, points = newest
        old_version, old_hash, old_ids = self.page.get() if self.page.exists() else (None, None, [])
        if old_version is not None and (version, hash_ or "") <= (old_version, old_hash or ""):
            return
        points = [] if hash_ is None else list(points)
        ids = [p["id"] for p in points]
        self.page.update((int(version), hash_, ids))
        if hash_ == old_hash and old_version is not None:
            return
        gone = sorted(set(old_ids) - set(ids))
        out = [("upsert", p["id"], key[0], p["section"], p["text"], hash_, int(version)) for p in points]
        out += [("delete", i, key[0], None, None, None, int(version)) for i in gone]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ACTIONS.split(", ")])

    def close(self) -> None:
        pass


def pointed(pages: DataFrame) -> DataFrame:
    """``page_id, version, page_hash, points`` of ``page_id, markdown, version``; a null text has no hash."""
    cut = retrieval.section_lists(pages.where("page_id IS NOT NULL AND version IS NOT NULL"), "markdown")
    point = lambda s: F.struct(text.point_id(F.col("page_id"), s["section"]).alias("id"), s["section"].alias("section"), s["text"].alias("text"))
    return cut.select("page_id", "version", F.sha2("markdown", 256).alias("page_hash"), F.coalesce(F.transform("sections", point), F.array()).alias("points"))


def actions(pages: DataFrame) -> DataFrame:
    """The stream of ``ACTIONS`` for a stream of ``page_id, markdown, version``."""
    return pointed(pages).groupBy("page_id").transformWithStateInPandas(PageState(), ACTIONS, "append", "none")


def follow(spark: SparkSession, source: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Write the actions for page files (JSON lines) as they come to a Parquet table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(source)
    return actions(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(acted: DataFrame) -> DataFrame:
    """The points that are left after some actions: of each id what its newest version says."""
    last = acted.groupBy("id").agg(F.max_by(F.struct("action", "page_id", "section", "text", "page_hash", "version"), F.struct("version", F.coalesce("page_hash", F.lit("")))).alias("p"))
    return last.where("p.action = 'upsert'").select("id", "p.page_id", "p.section", "p.text", "p.page_hash", "p.version")
