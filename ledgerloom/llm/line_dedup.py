"""Line deduplication over overlapping windows of three lines. Only DataFrame functions.

Each window of three consecutive lines that are not blank is hashed (128 bits). The
first pass finds windows that occur more than once anywhere and the first place of
each, by an aggregate that is combined before the shuffle. The second joins the
windows to these, which gives the later occurrences; the lines they cover are merged
in each document and removed. Only hashes and places are shuffled for windows; a text
moves once, to meet the lines it loses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
TRIM = " \t\r"


def _solid(lines: Column) -> Column:
    """Places and hashes of the lines that are not blank."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(TRIM)).alias("line")))
    return F.transform(
        F.filter(placed, lambda s: s["line"] != ""),
        lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["line"]).alias("a"), F.xxhash64(s["line"], F.lit(7)).alias("b")),
    )


def _windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, k, a, b)``: window k of each document and its two hashes."""
    split = docs.select("doc_id", "version", _solid(F.split("text", "\n")).alias("solid")).where(F.size("solid") >= WINDOW)
    solid = F.col("solid")

    def hashed(k: Column) -> Column:
        parts = [solid[k + i][name] for i in range(WINDOW) for name in ("a", "b")]
        return F.struct(k.alias("k"), F.xxhash64(*parts).alias("a"), F.xxhash64(*parts[::-1]).alias("b"))

    each = F.transform(F.sequence(F.lit(0), F.size(solid) - WINDOW), hashed)
    return split.select("doc_id", "version", F.explode(each).alias("w")).select("doc_id", "version", "w.k", "w.a", "w.b")


def dedup_lines(documents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Remove later occurrences of repeated windows of three lines.

    Lines end at ``\\n`` and are compared without blanks, tabs and ``\\r`` around them;
    blank lines belong to no window and stay. Occurrences are ordered by doc_id and
    place; the first stays whole, also against occurrences that overlap it in its own
    document. Returns ``doc_id, text, n_lines, removed`` (places of removed lines,
    ascending), a row for each input row.

    Null text: ``n_lines`` 0, text null. Fewer than three such lines: unchanged. Rows
    that repeat a doc_id and its text count as one document and all get its result;
    rows of one doc_id with other texts are ordered by a hash of the text. A null
    doc_id orders first. Other columns are ignored, but for those named in ``carry``,
    which come back in a struct ``carried``; an empty table stays empty.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    docs = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).withColumn("version", F.xxhash64("text"))
    more = ["carried"] if carry else []
    windows = _windows(docs)
    place = F.struct("doc_id", "version", "k")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("a", "b", "first")
    )
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    later = (
        windows.join(repeated, ["a", "b"])
        .where(~(own & (F.col("k") == F.col("first.k"))))
        .select(
            "doc_id",
            "version",
            F.when(own, F.greatest(F.col("k"), F.col("first.k") + WINDOW)).otherwise(F.col("k")).alias("from"),
            (F.col("k") + WINDOW - 1).alias("to"),
        )
    )
    covered = (
        later.groupBy("doc_id", "version")
        .agg(F.collect_set(F.struct("from", "to")).alias("spans"))
        .select(F.col("doc_id").alias("of"), F.col("version").alias("its"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["to"])))).alias("covered"))
    )
    joined = docs.join(covered, docs.doc_id.eqNullSafe(covered["of"]) & (docs.version == covered["its"]), "left")
    joined = joined.select("doc_id", "text", *more, "covered", F.split("text", "\n").alias("lines"))
    joined = joined.select("doc_id", "text", *more, "covered", "lines", F.when(F.col("covered").isNotNull(), _solid(F.col("lines"))).alias("solid"))
    removed = F.array_sort(F.transform("covered", lambda k: F.col("solid")[k]["at"]))
    joined = joined.select("doc_id", "text", *more, "lines", F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    joined = joined.withColumn("stay", F.when(F.size("removed") > 0, stay))
    text = F.when(F.size("removed") > 0, F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"), "removed", *more)
