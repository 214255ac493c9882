"""Fact bases: one JSON document, read with a fixed schema and laid out as flat tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import ordinals

INDEX = (
    "commit string, entries array<struct<id:string,kind:string,module:string,layer:string,location:string,dependencies:array<string>,"
    "guards:array<struct<id:string,kind:string,condition:string,exit:string,location:string,via:string,structured:struct<left:string,op:string,right:string>>>,"
    "edges:array<struct<type:string,target:string,detail:string>>,chunks:array<struct<symbol:string,location:string,endLine:int,text:string>>,hash:string>>,"
    "entities array<struct<id:string,name:string,module:string,location:string,table:string,"
    "fields:array<struct<name:string,type:string,column:string,enumValues:array<string>>>,"
    "transitions:array<struct<field:string,`from`:string,to:string,method:string,location:string,condition:string>>,raisedEvents:array<string>>>,"
    "config array<struct<key:string,kind:string,`default`:string,location:string>>"
)
MANIFEST = "commit string, pages array<struct<pageId:string,path:string,title:string,kind:string,parentPageId:string,hash:string>>"
GLOSSARY = "array<struct<term:string,codeName:string,meaning:string>>"


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of a fixed schema; malformed or empty ones are errors."""
    out = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if out.isEmpty():
        raise ValueError(f"{path} is empty")
    return out


def write_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


@dataclass
class Facts:
    """The flat tables. ``pos`` is the place in the document: order is meaning."""

    entries: DataFrame
    guards: DataFrame
    edges: DataFrame
    chunks: DataFrame
    entities: DataFrame
    fields: DataFrame
    transitions: DataFrame
    raised: DataFrame
    config: DataFrame


def flatten(index: DataFrame) -> Facts:
    e = index.select("commit", F.posexplode("entries").alias("pos", "e")).select("commit", F.col("pos").alias("entry_pos"), F.col("e.id").alias("entry_id"), "e.*").drop("id")
    each = lambda df, key, column: df.select(key, F.posexplode(column).alias("pos", "x")).select(key, "pos", "x.*")
    g = each(e, "entry_id", "guards")
    guards = g.select("entry_id", "pos", F.col("id").alias("guard_id"), "kind", "condition", "exit", "location", scalars.location_path(F.col("location")).alias("path"), scalars.location_line(F.col("location")).alias("line"), "via", F.col("structured.left").alias("left_side"), F.col("structured.op").alias("op"), F.col("structured.right").alias("right_side"))
    c = each(e, "entry_id", "chunks")
    chunks = c.select("entry_id", "pos", "symbol", scalars.location_path(F.col("location")).alias("path"), scalars.location_line(F.col("location")).alias("start_line"), F.col("endLine").alias("end_line"), "text")
    n = index.select(F.posexplode("entities").alias("entity_pos", "n")).select("entity_pos", F.col("n.id").alias("entity_id"), F.col("n.name").alias("entity"), "n.module", "n.location", "n.table", "n.fields", "n.transitions", "n.raisedEvents")
    t = each(n, "entity", "transitions")
    return Facts(
        e.select("commit", "entry_pos", "entry_id", "kind", "module", "layer", "location", "dependencies", "hash"),
        guards,
        each(e, "entry_id", "edges"),
        chunks,
        n.select("entity_pos", "entity_id", "entity", "module", "location", "table"),
        each(n, "entity", "fields").withColumnRenamed("enumValues", "enum_values"),
        t.select("entity", "pos", "field", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "method", "location", "condition"),
        n.select("entity", F.posexplode(F.array_distinct("raisedEvents")).alias("pos", "event")),
        index.select(F.posexplode("config").alias("pos", "c")).select("pos", "c.*"),
    )


def load(spark: SparkSession, path: str) -> Facts:
    return flatten(read_document(spark, path, INDEX))


def manifest(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """``page_id, path, title, kind, parent_page_id, hash`` of each page; empty if it may be missing and is."""
    columns = ["pageId AS page_id", "path", "title", "kind", "parentPageId AS parent_page_id", "hash"]
    try:
        return read_document(spark, path, MANIFEST).select(F.explode("pages").alias("p")).select("p.*").selectExpr(*columns)
    except Exception as error:  # a path that isn't there
        if not optional or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "page_id string, path string, title string, kind string, parent_page_id string, hash string")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Manual glossary entries; none if the file is missing."""
    try:
        text = spark.read.text(path, wholetext=True)
        out = text.select(F.explode(F.from_json("value", GLOSSARY)).alias("g")).select("g.term", F.col("g.codeName").alias("code_name"), "g.meaning")
        out.schema  # noqa: B018  the path is looked up here
        return out
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "term string, code_name string, meaning string")


def resolve_tables(entities: DataFrame, mapped: DataFrame, sets: DataFrame) -> DataFrame:
    """Table of each entity: mapped by hand, else the name of its set in snake_case, else null."""
    return entities.join(mapped.select("entity", F.col("table").alias("_mapped")), "entity", "left").join(sets.select("entity", F.col("set_name")), "entity", "left").withColumn("table", F.coalesce("_mapped", scalars.snake_acronyms(F.col("set_name")))).drop("_mapped", "set_name")


def resolve_columns(fields: DataFrame, entities: DataFrame, mapped: DataFrame) -> DataFrame:
    """Column of each field, only where the entity has a table: mapped by hand, else the name in snake_case."""
    named = fields.drop("column").join(mapped.select("entity", "name", F.col("column").alias("_mapped")), ["entity", "name"], "left").join(entities.select("entity", "table"), "entity", "left")
    return named.withColumn("column", F.when(F.col("table").isNotNull(), F.coalesce("_mapped", scalars.snake_acronyms(F.col("name"))))).drop("_mapped", "table")


def number_guards(guards: DataFrame) -> DataFrame:
    """Ids ``G1`` ... in execution order."""
    return ordinals.numbered(guards.drop("guard_id"), ["entry_id"], ["pos"], "guard_id", "G")


def entry_hashes(facts: Facts) -> DataFrame:
    """A hash of chunks, guards and edges of each entry."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != "entry_id"]
        return df.groupBy("entry_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"])))).alias(name))

    out = facts.entries.select("entry_id")
    for name in ("chunks", "guards", "edges"):
        out = out.join(packed(getattr(facts, name), name), "entry_id", "left")
    return out.select("entry_id", F.sha2(F.concat_ws("\n\u0001", F.coalesce("chunks", F.lit("")), F.coalesce("guards", F.lit("")), F.coalesce("edges", F.lit(""))), 256).alias("hash"))
