"""Writing result tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ledgerlens.session import delete, exists, read_text, rename, write_text


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    as_cell = lambda f: F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
    return df.select(*map(as_cell, df.schema))


def save_table(df: DataFrame, path: str) -> None:
    """CSV with a header in folder `path`, replacing what was there."""
    _flat(df).write.mode("overwrite").option("header", True).csv(path)


def save_reports(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Write every non-empty table below `folder`; returns the names written.

    All tables are written aside and counted by the jobs that write them, then the whole report takes the place of
    the one before, then its manifest (`folder`.manifest.json: names, rows, columns) is replaced. If a table fails,
    the report before stays as it was.
    """
    present = {name: table for name, table in tables.items() if table is not None}
    if not present:
        return []
    spark = next(iter(present.values())).sparkSession
    folder, run = folder.rstrip("/"), uuid.uuid4().hex
    aside, old = f"{folder}.new-{run}", f"{folder}.old-{run}"
    entries = []
    try:
        for name, table in present.items():
            path, seen = f"{aside}/{name}", Observation()
            save_table(table.observe(seen, F.count(F.lit(1)).alias("rows")), path)
            if seen.get["rows"]:
                entries.append({"name": name, "rows": seen.get["rows"], "schema": _flat(table).schema.json()})
            else:
                delete(spark, path)
        if exists(spark, folder):
            rename(spark, folder, old)
        try:
            if entries:
                rename(spark, aside, folder)
        except Exception:
            if exists(spark, old):
                rename(spark, old, folder)
            raise
    finally:
        delete(spark, aside)
    write_text(spark, f"{folder}.manifest.json", json.dumps(entries, indent=1))
    delete(spark, old)
    return [e["name"] for e in entries]


def read_reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved report, with their types, in the order in which they were given."""
    folder = folder.rstrip("/")
    out = {}
    for entry in json.loads(read_text(spark, f"{folder}.manifest.json")):
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        out[entry["name"]] = spark.read.option("header", True).schema(schema).csv(f"{folder}/{entry['name']}")
    return out
