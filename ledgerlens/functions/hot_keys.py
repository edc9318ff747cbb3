"""Equality joins whose left side may hold a few keys very often.

Keys that hold more than a part in `MOST` of the left rows are found by count; there are fewer than MOST of them.
Their left rows stay where they are and meet the right rows through a broadcast, all others are joined as usual. So
no task gets more than its share, with or without adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import stage

MOST = 400


def hot_keys(left: DataFrame, keys: Sequence[str], most: int = MOST) -> DataFrame:
    """The keys that hold more than one in `most` of the rows, by way of the driver."""
    return left.sparkSession.createDataFrame(_hot(left, keys, most))


def _hot(left: DataFrame, keys: Sequence[str], most: int) -> pa.Table:
    # One row per key is staged, so the rows are read once for their keys and their number.
    counted = stage(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    return counted.where(F.col("_n") * most > total).select(*keys).toArrow()


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int = MOST) -> DataFrame:
    """`left` joined with `right` by `keys`: inner, left_semi or left_anti. `right` has one row per key.

    `left` is read twice, or three times if it has hot keys; stage it if it is costly. Null keys meet nothing.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how must be 'inner', 'left_semi' or 'left_anti'")
    found = _hot(left, keys, most)
    if not len(found):
        return left.join(right, list(keys), how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found))
    few = right.join(hot, list(keys), "left_semi")
    usual = left.join(hot, list(keys), "left_anti").join(right, list(keys), how)
    return usual.unionByName(left.join(hot, list(keys), "left_semi").join(F.broadcast(few), list(keys), how))
