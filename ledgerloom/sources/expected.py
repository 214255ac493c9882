"""Expected facts of some entries and entities, and the check of a fact base against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import sync
from ledgerloom.sources.facts import Facts


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, id, line)`` of a JSON document ``{"entries": {id: {"guards": [...], "edges": [...]}}, "entities": {id: {"table", "columns", "transitions"}}}``.

    Names of members count without regard to case. Lines are as ``actual`` writes them;
    ``columns`` are expected only where they are given (then a line ``columns`` says so).
    """
    document = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))

    def member(json: Column, name: str) -> Column:
        found = F.filter(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.lower(e["key"]) == name)
        return F.try_element_at(found, F.lit(1))["value"]

    def each(name: str) -> DataFrame:
        return document.select(F.explode(F.from_json(member(F.col("json"), name), "map<string,string>")).alias("id", "value"))

    def lines(df: DataFrame, kind: str, name: str, prefix: str = "") -> DataFrame:
        listed = F.explode(F.from_json(member(F.col("value"), name), "array<string>"))
        return df.select(F.lit(kind).alias("kind"), "id", listed.alias("x")).select("kind", "id", F.concat(F.lit(prefix), "x").alias("line"))

    entries, entities = each("entries"), each("entities")
    out = lines(entries, "entry", "guards").unionByName(lines(entries, "entry", "edges"))
    out = out.unionByName(lines(entities, "entity", "transitions", "transition ")).unionByName(lines(entities, "entity", "columns", "column "))
    table = entities.select(F.lit("entity").alias("kind"), "id", F.concat(F.lit("table "), F.coalesce(member(F.col("value"), "table"), F.lit("null"))).alias("line"))
    asked = entities.where(member(F.col("value"), "columns").isNotNull()).select(F.lit("entity").alias("kind"), "id", F.lit("columns").alias("line"))
    there = entries.select(F.lit("entry").alias("kind"), "id", F.lit("").alias("line"))
    return out.unionByName(table).unionByName(asked).unionByName(there)


def actual(facts: Facts) -> DataFrame:
    """``(kind, id, line)`` of a fact base: guards but for passed-on errors, edges, tables, columns and transitions."""
    line = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), text.alias("line"))
    shown = F.concat_ws(" ", "type", "target", F.when(F.col("detail").isNotNull(), F.concat(F.lit("["), "detail", F.lit("]"))))
    ids = facts.entities.select("entity", "entity_id")
    fields = facts.fields.join(ids, "entity")
    moves = facts.transitions.join(ids, "entity")
    out = line(facts.entries, "entry", "entry_id", F.lit(""))
    out = out.unionByName(line(facts.guards.where("exit <> 'propagate'"), "entry", "entry_id", F.concat_ws(" ", "location", "exit")))
    out = out.unionByName(line(facts.edges, "entry", "entry_id", shown))
    out = out.unionByName(line(facts.entities, "entity", "entity_id", F.concat(F.lit("table "), F.coalesce("table", F.lit("null")))))
    out = out.unionByName(line(fields, "entity", "entity_id", F.concat(F.lit("column "), "name", F.lit(" "), F.coalesce("column", F.lit("null")))))
    return out.unionByName(line(moves, "entity", "entity_id", F.concat(F.lit("transition "), "field", F.lit(" "), F.coalesce("from_state", F.lit("*")), F.lit(" -> "), "to_state", F.lit(" via "), F.coalesce("method", F.lit("")))))


def check(facts: Facts, expected: DataFrame) -> DataFrame:
    """``(kind, id, line, side)``: ``not found``, ``missing`` (both are failures) and ``extra`` lines of what is expected.

    Entries and entities that nothing is expected of are left alone, as are behaviors, and
    columns where none are listed.
    """
    named, asked = expected.select("kind", "id").distinct(), expected.where("line = 'columns'").select("kind", "id").distinct()
    expected = expected.where("line <> 'columns'")
    own = actual(facts).join(named, ["kind", "id"], "left_semi")
    columns = own.where("line LIKE 'column %'").join(asked, ["kind", "id"], "left_semi")
    own = own.where("line NOT LIKE 'column %'").unionByName(columns)
    known = own.select("kind", "id").distinct()
    lost = named.join(known, ["kind", "id"], "left_anti").select("kind", "id", F.lit("").alias("line"), F.lit("not found").alias("side"))
    found = expected.join(known, ["kind", "id"], "left_semi")
    diff = sync.golden_diff(found, own, ["kind", "id", "line"], F.col("line").startswith("behavior "))
    return diff.unionByName(lost)
