"""Operators in which order carries meaning: numbering, runs, breaks, first matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "n", prefix: str = "") -> DataFrame:
    """Numbers from 1 in each group, with a prefix as text."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.concat(F.lit(prefix), n.cast("string")) if prefix else n)


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group: an aggregate, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in by and c not in order]
    first = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*by, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def runs(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers in each group: ``by, low, high``."""
    distinct = df.select(*by, value).distinct()
    island = distinct.withColumn("_island", F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    return island.groupBy(*by, "_island").agg(F.min(value).alias("low"), F.max(value).alias("high")).drop("_island")


def run_text(df: DataFrame, by: Sequence[str], last: str = " and ") -> DataFrame:
    """Runs of each group as text: ``1, 3–5 and 9``."""
    part = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat(F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("low", part.alias("part")))), lambda s: s["part"])
    out = df.groupBy(*by).agg(parts.alias("_parts"))
    head = F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - 1), ", ")
    text = F.when(F.size("_parts") == 1, F.element_at("_parts", 1)).otherwise(F.concat(head, F.lit(last), F.element_at("_parts", -1)))
    return out.select(*by, text.alias("text"))


def merge_adjacent(df: DataFrame, by: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Number groups of neighbours that agree in ``same``: column ``run`` from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.struct(*same)
    changed = F.when(F.lag(now).over(w).eqNullSafe(now), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def breaks(steps: DataFrame, by: str, no: str, state: str, outcome: str) -> DataFrame:
    """Of each process: last done step before the break, the break (first step not done after a done one), the last negative outcome of done steps."""
    w = Window.partitionBy(by).orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.withColumn("_before", F.coalesce(F.bool_or(F.col(state) == "done").over(w), F.lit(False)))
    at = F.min(F.when((F.col(state) == "not_done") & F.col("_before"), F.col(no)))
    facts = seen.withColumn("break_no", at.over(Window.partitionBy(by)))
    done = F.col(state) == "done"
    return facts.groupBy(by).agg(
        F.max("break_no").alias("break_no"),
        F.coalesce(F.max(F.when(done & (F.col(no) < F.col("break_no")), F.col(no))), F.lit(0)).alias("last_done"),
        F.count_if(done).alias("n_done"),
        F.max_by(outcome, F.when(done & F.col(outcome).isNotNull(), F.col(no))).alias("negative"),
    )


def leaves(df: DataFrame, by: Sequence[str], no: str, parent: str) -> DataFrame:
    """Rows that are nobody's parent."""
    parents = df.select(*[F.col(c).alias(f"_p_{c}") for c in by], F.col(parent).alias("_p"))
    same = df[no] == parents["_p"]
    for c in by:
        same = same & (df[c] == parents[f"_p_{c}"])
    return df.join(parents, same, "left_anti")


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; the order must be total to be stable."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def node_letter(n: Column) -> Column:
    """Names of diagram nodes for 1, 2 ...: A to Z, then N26, N27 ..."""
    return F.when(n <= 26, F.chr(64 + n)).otherwise(F.concat(F.lit("N"), (n - 1).cast("string")))


def final_values(transitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct targets of transitions, ``is_final`` if never a source."""
    targets = transitions.select(*by, F.col("to_state").alias("state")).distinct()
    sources = transitions.select(*by, F.col("from_state").alias("state"), F.lit(False).alias("_final")).distinct()
    return targets.join(sources, [*by, "state"], "left").select(*by, "state", F.coalesce("_final", F.lit(True)).alias("is_final"))


def ordered_join(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: texts joined in order (nulls are left out)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), separator)


def ordered_distinct(value: Column, order: Column) -> Column:
    """Aggregate: distinct values in order of their first place."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]))
