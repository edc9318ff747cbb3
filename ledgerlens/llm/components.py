"""Connected components of links between text keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import stage


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every key in `links` (a, b); label is the lowest key of its component.

    Each round a key takes the lowest label among its own, its neighbours' and that of its label. Rounds are
    staged, so a lost executor repeats one round at most; a key with very many links is met as partial minima.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"))
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.key == near.a).select("key", "label", F.least("label", "near").alias("low"))
        onward = labels.select(F.col("key").alias("low"), F.col("label").alias("far"))
        step = stage(
            step.join(onward, "low", "left").select("key", F.least("low", F.coalesce("far", "low")).alias("low"), "label")
        )
        labels = step.select("key", F.col("low").alias("label"))
        if step.where("low != label").isEmpty():
            return labels
