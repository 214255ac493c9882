"""Joins of the fact base. Each is an equi join on something; none is a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge types by which an entry triggers another.
TRIGGERS = ("sends", "publishes")


def handlers(edges: DataFrame) -> DataFrame:
    """``(message, handler)``: the message type of each handler, by its first ``handles`` edge."""
    own = edges.where(F.col("type") == "handles").groupBy("entry_id").agg(F.min_by("target", "pos").alias("message"))
    return own.select("message", F.col("entry_id").alias("handler"))


def incoming(edges: DataFrame) -> DataFrame:
    """``(handler, source, type, message)``: who sends or publishes what a handler handles."""
    sent = edges.where(F.col("type").isin(*TRIGGERS)).select(F.col("entry_id").alias("source"), "type", F.col("target").alias("message"))
    return sent.join(handlers(edges), "message").select("handler", "source", "type", "message")


def outgoing(edges: DataFrame) -> DataFrame:
    """``(source, pos, type, message, handler)``: where an entry leads; handler null when nothing handles it."""
    sent = edges.where(F.col("type").isin(*TRIGGERS)).select(F.col("entry_id").alias("source"), "pos", "type", F.col("target").alias("message"))
    return sent.join(handlers(edges), "message", "left").select("source", "pos", "type", "message", "handler")


def attach_lists(left: DataFrame, right: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Put the ordered values that ``right`` has for a key before the array of the same name of ``left``."""
    more = right.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column]).alias("_more"))
    joined = left.join(more, key, "left")
    return joined.withColumn(column, F.concat(F.coalesce("_more", F.array().cast(left.schema[column].dataType)), F.col(column))).drop("_more")


def attach_all(left: DataFrame, small: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row with each row of a small side (behaviors onto handlers).

    The small side is counted. At most ``most`` rows of it are broadcast at a time; more are
    attached in blocks, each in a pass of its own, so the result may be as large as it is
    but nothing that is broadcast is.
    """
    names, rows = small.columns, small.count()
    blocks = max(1, -(-rows // most))
    block = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in names]), F.lit(blocks))
    out = None
    for b in range(blocks):
        part = small if blocks == 1 else small.where(block == b)
        one = left.withColumn("_k", F.lit(1)).join(F.broadcast(part.select(F.lit(1).alias("_k"), *names)), "_k").drop("_k")
        out = one if out is None else out.unionByName(one)
    return out


def or_lookup(left: DataFrame, right: DataFrame, row_id: str, keys: Sequence[tuple[str, str]], order: str, keep: Sequence[str]) -> DataFrame:
    """The first row of ``right`` (by ``order``) that agrees with ``left`` in any pair of keys; left outer.

    A join on ``a = x OR b = y`` would compare all pairs; here each pair of keys is an
    equi join and the first match of their union stays.
    """
    tries = None
    for i, (a, b) in enumerate(keys):
        one = left.select(row_id, F.col(a).alias(f"_k{i}")).join(right.select(F.col(b).alias(f"_k{i}"), F.col(order).alias("_order"), *[F.col(k).alias(f"_r_{k}") for k in keep]), f"_k{i}").drop(f"_k{i}")
        tries = one if tries is None else tries.unionByName(one)
    first = tries.groupBy(row_id).agg(F.min(F.struct("_order", *[f"_r_{k}" for k in keep])).alias("_first"))
    return left.join(first, row_id, "left").select(left["*"], *[F.col(f"_first._r_{k}").alias(k) for k in keep])


def range_semi(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, width: int = 1000) -> DataFrame:
    """Points inside any span of their key (bounds count); joined on (key, cell of ``width``).

    A span's full cells need no comparison, so each is one row of (key, cell) however many
    spans cover it; only points in cells that a span's ends lie in are compared with it.
    """
    cell = lambda x: F.floor(F.col(x) / width)
    s = spans.select(F.col(key).alias("_key"), F.col(low).alias("_low"), F.col(high).alias("_high"), cell(low).alias("_a"), cell(high).alias("_b")).where("_low <= _high")
    full = s.where("_b - _a > 1").select("_key", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("_cell")).distinct()
    ends = s.select("_key", "_low", "_high", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_cell"))
    # Of the spans that meet in a cell, those that begin (or end) in it count by their widest reach.
    first = ends.select("_key", "_cell", F.greatest("_low", F.col("_cell") * width).alias("_low"), F.least("_high", (F.col("_cell") + 1) * width).alias("_high")).distinct()
    cells = full.select("_key", "_cell", (F.col("_cell") * width).alias("_low"), ((F.col("_cell") + 1) * width).alias("_high")).unionByName(first)
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    return p.join(cells.withColumnRenamed("_cell", "_c"), (p[key] == F.col("_key")) & (p["_cell"] == F.col("_c")) & F.col(at).between(F.col("_low"), F.col("_high")), "left_semi").drop("_cell")


def semi_or(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], local: Column) -> DataFrame:
    """Rows of ``left`` that a local predicate holds for, or that have a match in ``right`` (an existence join)."""
    matched = right.select(*[F.col(b).alias(f"_r_{b}") for _, b in keys]).distinct().withColumn("_there", F.lit(True))
    on = [F.col(a) == F.col(f"_r_{b}") for a, b in keys]
    own = F.coalesce(local, F.lit(False))
    rest = left.where(~own).join(matched, on, "left_semi")
    return left.where(own).unionByName(rest)


#: A stretch of a level has 2**``_BITS`` of the level below.
_BITS = 2


def _numbers(low: Column, high: Column, level: Column) -> Column:
    """The stretches of a level among the fewest aligned ones that together are the numbers from low to high; at most three at each end."""
    side, none = 1 << _BITS, F.array().cast("array<bigint>")
    first = -F.call_function("shiftright", -low, level * _BITS)  # rounded up
    end = F.call_function("shiftright", high + 1, level * _BITS)
    up, down = -F.call_function("shiftright", -first, F.lit(_BITS)), F.call_function("shiftright", end, F.lit(_BITS))
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    return F.when(up > down, run(first, end)).otherwise(F.concat(run(first, up * side), run(down * side, end)))


def range_lookup(points: DataFrame, spans: DataFrame, row_id: str, key: str, at: str, low: str, high: str, order: str, keep: Sequence[str]) -> DataFrame:
    """The first span (by ``order``) that covers each point (bounds count); left outer. Places are whole numbers.

    A span of n numbers is cut into at most 3 log n aligned stretches, of each of which the
    first span stays, and a point lies in one stretch of each level, so the join is on (key,
    level, stretch): its work follows points and spans, not their pairs. Both sides are
    sorted for it: a table of stretches is far larger than Spark takes it for, and is not
    broadcast.
    """
    for df, c in ((points, at), (spans, low), (spans, high)):
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise TypeError(f"{c} is not a whole number")
    a, b = F.col(low).cast("bigint"), F.col(high).cast("bigint")
    s = spans.where(a <= b).select(F.col(key).alias("_key"), a.alias("_low"), b.alias("_high"), F.struct(F.col(order).alias("_order"), *keep).alias("_span"))
    widest = s.agg(F.max(F.coalesce(F.try_subtract("_high", "_low"), F.lit((1 << 63) - 1)))).first()[0]
    if widest is None:
        return points.select("*", *[F.lit(None).cast(spans.schema[k].dataType).alias(k) for k in keep])
    levels = F.explode(F.array(*[F.lit(x) for x in range(1 + ((widest + 1).bit_length() - 1) // _BITS)])).alias("_level")
    s = s.select("*", levels).select("_key", "_level", F.explode(_numbers(F.col("_low"), F.col("_high"), F.col("_level"))).alias("_number"), "_span")
    s = s.groupBy("_key", "_level", "_number").agg(F.min("_span").alias("_span"))
    p = points.select(F.col(row_id).alias("_row"), F.col(key).alias("_key"), F.col(at).cast("bigint").alias("_at"), levels)
    p = p.select("_row", "_key", "_level", F.call_function("shiftright", F.col("_at"), F.col("_level") * _BITS).alias("_number"))
    first = p.join(s.hint("merge"), ["_key", "_level", "_number"]).groupBy("_row").agg(F.min("_span").alias("_first"))
    return points.join(first, points[row_id] == first["_row"], "left").select(points["*"], *[F.col(f"_first.{k}").alias(k) for k in keep])


def asof_forward(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each row of ``left`` the ``value`` of the first row of ``right`` with the same key at or after it; left outer.

    Both sides are laid on one line for each key, the furthest first; the value that was
    seen last is carried along, so a key takes one pass. No pairs are made.
    """
    cols = left.columns
    a = left.select("*", F.lit(0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[at].dataType).alias("_found"))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols if c not in (key, at)]
    b = right.select(F.col(key), F.col(at), *blank, F.lit(1).alias("_side"), F.col(value).alias("_value"), F.col(at).alias("_found"))
    seen = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_side"), F.desc("_value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = a.unionByName(b)
    line = line.withColumn("next_at", F.last("_found", True).over(seen)).withColumn("next_value", F.last("_value", True).over(seen))
    return line.where(F.col("_side") == 0).select(*cols, "next_at", "next_value")


def divide(pairs: DataFrame, of: str, by: str, wanted: DataFrame) -> DataFrame:
    """Relational division: values of ``of`` that have every value of ``by`` that ``wanted`` has; nothing is asked of nulls."""
    asked = wanted.select(by).where(F.col(by).isNotNull()).distinct()
    have = pairs.select(of, by).join(asked, by, "left_semi").groupBy(of).agg(F.count_distinct(by).alias("_n"))
    return have.join(asked.agg(F.count(F.lit(1)).alias("_n")), "_n", "left_semi").select(of)


def priority_lookup(left: DataFrame, right: DataFrame, row_id: str, candidates: Sequence[Column], key: str, keep: Sequence[str]) -> DataFrame:
    """The row of ``right`` for the first candidate key that it has (without regard to case); left outer."""
    tries = F.filter(F.array(*[F.struct(F.lit(i).alias("rank"), F.lower(c).alias("_key")) for i, c in enumerate(candidates)]), lambda s: s["_key"].isNotNull())
    asked = left.select(row_id, F.explode(tries).alias("t")).select(row_id, "t.rank", "t._key")
    found = asked.join(right.select(F.lower(F.col(key)).alias("_key"), *keep), "_key")
    first = found.groupBy(row_id).agg(F.min(F.struct("rank", *keep)).alias("_first"))
    return left.join(first, row_id, "left").select(left["*"], F.col("_first.rank").alias("rank"), *[F.col(f"_first.{k}").alias(k) for k in keep])


def lookup_default(left: DataFrame, right: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``value`` of the right row with the same key, else a default."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def map_value(row: Column, candidates: Sequence[Column]) -> Column:
    """The value of the first candidate key that a map of text has (keys without regard to case); a null value ends the search."""
    low = F.map_from_entries(F.transform(F.map_entries(row), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    out = F.lit(None).cast("string")
    for c in reversed(candidates):
        out = F.when(F.coalesce(F.map_contains_key(low, F.lower(c)), F.lit(False)), F.try_element_at(low, F.lower(c))).otherwise(out)
    return out


def map_has(row: Column, candidates: Sequence[Column]) -> Column:
    """Whether a map has any of the candidate keys."""
    keys = F.transform(F.map_keys(row), lambda k: F.lower(k))
    out = F.lit(False)
    for c in candidates:
        out = out | F.coalesce(F.array_contains(keys, F.lower(c)), F.lit(False))
    return out


def by_id_array(left: DataFrame, right: DataFrame, row_id: str, array: str, key: str, keep: str) -> DataFrame:
    """``keep`` of the rows named by an array of ids, in the array's order; missing ids are passed over."""
    each = left.select(row_id, F.posexplode(array).alias("_pos", key))
    found = each.join(right.select(key, keep), key).groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", keep))), lambda s: s[keep]).alias(f"{keep}_list"))
    return left.join(found, row_id, "left").withColumn(f"{keep}_list", F.coalesce(f"{keep}_list", F.array().cast(found.schema[f"{keep}_list"].dataType)))


def override_union(manual: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """All manual rows, and the proposed ones whose key (without regard to case) no manual row has."""
    taken = manual.select(F.lower(F.col(key)).alias("_key"))
    rest = proposed.join(taken, F.lower(proposed[key]) == taken["_key"], "left_anti")
    return manual.withColumn("manual", F.lit(True)).unionByName(rest.withColumn("manual", F.lit(False)))
