"""Exact distinct counts per group and overall, from one row per value.

Each value gets a bitmap of the groups in which it occurs. Bitmaps of the same value are merged by OR wherever
they meet, first in the tasks that read the rows, so what is shuffled is one short row per value; a group's count
is the number of bitmaps with its bit, the overall count the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

GROUPS = 63  # bits of a bitmap; further groups take further bitmaps


def distinct_by_group(df: DataFrame, column: str, group: Column, groups: Sequence[int]) -> DataFrame:
    """(Group, Count) of the non-null values of `column` for whole numbers `groups`, and for all of them as null.

    Rows whose group is none of `groups` count for the overall number only.
    """
    parts = [list(groups[a : a + GROUPS]) for a in range(0, len(groups), GROUPS)]
    masks = [
        reduce(lambda rest, g: F.when(group == g[1], F.lit(1 << g[0]).cast("long")).otherwise(rest), enumerate(part), F.lit(0).cast("long"))
        for part in parts
    ]
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(*(F.bit_or(m).alias(f"_m{i}") for i, m in enumerate(masks)), F.count(F.lit(1)).alias("_n"))
    counts = [(g, F.count_if(F.col(f"_m{i}").bitwiseAND(F.lit(1 << b).cast("long")) != 0)) for i, part in enumerate(parts) for b, g in enumerate(part)]
    total = values.agg(F.count(F.lit(1)).alias("_all"), *(c.alias(f"_g{k}") for k, (_, c) in enumerate(counts)))
    cells = [F.struct(F.lit(g).cast("int").alias("Group"), F.col(f"_g{k}").alias("Count")) for k, (g, _) in enumerate(counts)]
    cells.append(F.struct(F.lit(None).cast("int").alias("Group"), F.col("_all").alias("Count")))
    return total.select(F.explode(F.array(*cells)).alias("_e")).select("_e.*")


def nulls_and_values(df: DataFrame, column: str) -> DataFrame:
    """One row: missing rows and distinct values of a column, in its own type."""
    values = df.groupBy(F.col(f"`{column}`").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return values.agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("MissingValues"),
        F.count("_v").alias("UniqueValues"),
    )
