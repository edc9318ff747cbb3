"""A raw table of many parts, kept in columnar form and refreshed only where parts have changed.

A manifest names every part with the files it was made from (name, length, modification time) and its schema. A
refresh writes the parts whose files differ aside, then publishes a new manifest, then removes what no manifest
names. A run that breaks off leaves the old manifest and all it names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from ledgerlens.session import delete, exists, listed, read_text, write_text
from ledgerlens.sources import readers

MANIFEST = "manifest.json"


def fingerprint(spark: SparkSession, path: str) -> list[list]:
    """[name, length, modification time] of the data files below `path`, by name."""
    return sorted([name, size, at] for name, size, at in listed(spark, path) if not name.rpartition("/")[2].startswith(("_", ".")))


def read_manifest(spark: SparkSession, target: str) -> dict:
    path = f"{target}/{MANIFEST}"
    return json.loads(read_text(spark, path)) if exists(spark, path) else {"parts": {}}


def stale_parts(spark: SparkSession, paths: Sequence[str], target: str, fmt: str = "parquet", schema: T.StructType | None = None) -> list[str]:
    """The parts whose snapshot is missing or was made from other files, another format or another schema."""
    known = read_manifest(spark, target)["parts"]
    return [p for p in paths if {k: known.get(p, {}).get(k) for k in ("files", "format", "asked")} != _state(spark, p, fmt, schema)]


def _state(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> dict:
    return {"files": fingerprint(spark, path), "format": fmt, "asked": schema.json() if schema is not None else None}


def refresh(spark: SparkSession, paths: Sequence[str], target: str, fmt: str = "parquet", schema: T.StructType | None = None) -> list[str]:
    """Bring the snapshot in `target` up to date with the parts; returns the parts that were read again."""
    if not paths:
        raise ValueError("no input parts given")
    known = read_manifest(spark, target)["parts"]
    changed = stale_parts(spark, paths, target, fmt, schema)
    parts = {}
    for path in paths:
        if path not in changed:
            parts[path] = known[path]
            continue
        # The state before reading: files that change meanwhile make the part stale again.
        state = _state(spark, path, fmt, schema)
        part = readers.load_parts(spark, [path], fmt, schema)
        place = f"part-{hashlib.sha256(path.encode()).hexdigest()[:12]}-{uuid.uuid4().hex}"
        readers.save_raw(part, f"{target}/{place}")
        parts[path] = state | {"place": place, "schema": part.schema.json()}
    if parts != known:
        write_text(spark, f"{target}/{MANIFEST}", json.dumps({"parts": parts}, indent=1))
    for old in {p["place"] for p in known.values()} - {p["place"] for p in parts.values()}:
        delete(spark, f"{target}/{old}")
    return changed


def load(spark: SparkSession, target: str) -> DataFrame:
    """The stacked table of the snapshot."""
    parts = read_manifest(spark, target)["parts"]
    if not parts:
        raise ValueError(f"no snapshot in {target}")
    return readers.stack([readers.load_raw(spark, f"{target}/{p['place']}", T.StructType.fromJson(json.loads(p["schema"]))) for p in parts.values()])


def load_data(
    spark: SparkSession, paths: Sequence[str], target: str, fmt: str = "parquet", schema: T.StructType | None = None, use_cache: bool = True
) -> DataFrame:
    """The stacked parts by way of the snapshot. Without `use_cache` every part is read again."""
    if not use_cache:
        delete(spark, f"{target}/{MANIFEST}")
    refresh(spark, paths, target, fmt, schema)
    return load(spark, target)
