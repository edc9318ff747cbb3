"""Joins of documents with tables that have one row per distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def first_copies(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of `rows` (key, id, ...) whose id is the lowest of their text, with the columns of `texts` (key,
    one, ...). As the id takes part in the join, other copies of a text are spread over the partitions."""
    same = (rows["key"] == texts["key"]) & rows["id"].eqNullSafe(texts["one"])
    return rows.join(texts, same).drop(texts["key"])


def join_by_text(rows: DataFrame, table: DataFrame, id: str = "id") -> DataFrame:
    """`rows` (key, id, ...) with the columns that `table` (key, one, copies, ...) has for their text, else null.

    `one` is the lowest id of the text. The first copy finds its row by text and id, the others by text and a
    salt for which only rows of repeated texts are multiplied. So a text that a third of all documents share
    is spread over the partitions in both joins.
    """
    values = [c for c in table.columns if c not in ("key", "one", "copies")]
    found = F.struct(*values)
    first = table.select(F.col("key").alias("_first_key"), F.col("one").alias("_one"), found.alias("_first"))
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt")
    others = table.where("copies > 1").select(F.col("key").alias("_other_key"), found.alias("_other"), salts)
    out = rows.join(first, (F.col("key") == F.col("_first_key")) & F.col(id).eqNullSafe(F.col("_one")), "left")
    salt = F.pmod(F.xxhash64(id), F.lit(SALTS)).cast("int")
    out = out.join(others, (F.col("key") == F.col("_other_key")) & (salt == F.col("_salt")), "left")
    return out.select(*rows.columns, F.coalesce("_first", "_other").alias("_found")).select(*rows.columns, "_found.*")
