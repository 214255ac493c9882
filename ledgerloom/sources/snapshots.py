"""Case snapshots: JSON of table rows and configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Snapshots:
    """``cases (case_id)``, ``tables (case_id, table)``, ``rows (case_id, table, pos, row)``, ``config (case_id, key, value)``.

    A fetched table without rows is in ``tables`` only: "no rows" is a fact, "no table" is unknown.
    """

    cases: DataFrame
    tables: DataFrame
    rows: DataFrame
    config: DataFrame


def parse(cases: DataFrame) -> Snapshots:
    """From ``case_id, json``: ``{"tables": {...}, "config": {...}}`` or just the tables.

    Members that are no arrays and rows that are no objects are dropped. Values stay as
    raw JSON text (``1500.0`` is not ``1500``); a null is a key with a null value.
    """
    text_map = lambda c: F.from_json(c, "map<string,string>")
    root = cases.select("case_id", "json", text_map("json").alias("root"))
    tables_text = F.coalesce(F.try_element_at("root", F.lit("tables")), F.when(~F.coalesce(F.map_contains_key("root", "tables"), F.lit(False)), F.col("json")))
    tables = root.select("case_id", F.explode(text_map(tables_text)).alias("table", "value")).where(F.col("value").startswith("["))
    rows = tables.select("case_id", "table", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "row")).where(F.col("row").startswith("{"))
    config = root.select("case_id", F.explode(text_map(F.try_element_at("root", F.lit("config")))).alias("key", "value"))
    return Snapshots(cases.select("case_id"), tables.select("case_id", "table"), rows.select("case_id", "table", "pos", text_map("row").alias("row")), config)


def load(spark: SparkSession, path: str) -> Snapshots:
    """A case for each file, named after it."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "([^/]+?)(\\.json)?$", 1).alias("case_id"), F.col("value").alias("json"))
    return parse(files)
