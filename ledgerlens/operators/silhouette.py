"""Mean silhouette of an assignment, in two distances.

`squared` uses squared Euclidean distance: cluster sums are enough, two linear passes. For the plain distance
`euclidean` gives lower and upper bounds from cells: points of a cluster that share a cell of a grid are met as one,
by their centroid and spread. The mean distance from a point to the points of a cell is at least the distance D to
their centroid and at most sqrt(D^2 + s) with s their mean squared distance from it (both by Jensen's inequality),
so every mean has a bracket, and so has the silhouette. Its work grows with the points times the cells that hold
any; a finer grid narrows the bracket. `euclidean_exact` sums the distances of all points, see `distance_sums`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators import distance_sums
from ledgerlens.session import stage

# A block is what a task holds of the distinct points. Points meet in tiles that stay in a core's cache.
_BLOCK_ROWS, _LARGEST_BLOCK, _BLOCKS, _TILE = 2000, 20_000, 32, 256
_PLACES = 200_000  # points that say where blocks are cut


def squared(df: DataFrame, axes: Sequence[str], label: str = "Cluster", by: str = "K") -> DataFrame:
    """One row per `by` value: mean of (b - a) / max(a, b) over all rows."""
    norm = sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    clusters = df.groupBy(by, label).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        _exact_sum(norm).alias("q"),
        F.array(*(_exact_sum(F.col(a)) for a in axes)).alias("s"),
    )
    # A handful of clusters per model, gathered into one array per model.
    packed = clusters.groupBy(by).agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "q", "s")).alias("_all"))
    dot = lambda c: sum(
        (F.col(a) * c["s"][i] for i, a in enumerate(axes[1:], start=1)), F.col(axes[0]) * c["s"][0]
    )
    far = lambda c: (norm * c["n"] + c["q"] - 2 * dot(c))
    own = F.filter("_all", lambda c: c["c"] == F.col(label))[0]
    others = F.transform(F.filter("_all", lambda c: c["c"] != F.col(label)), lambda c: far(c) / c["n"])
    scored = df.join(F.broadcast(packed), by).select(
        by, own["n"].alias("_n"), far(own).alias("_own"), F.array_min(others).alias("_b")
    )
    # Rounding can leave a tiny negative sum where all points coincide.
    a = F.greatest(F.col("_own"), F.lit(0.0)) / F.nullif(F.col("_n") - 1, F.lit(0.0))
    value = F.when(F.col("_n") > 1, _score(a, F.col("_b"))).otherwise(0.0)
    return scored.groupBy(by).agg((_exact_sum(value) / F.count(F.lit(1))).alias("Silhouette"))


def _exact_sum(value):
    """A sum that does not depend on the order of its rows."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def _score(a, b):
    return F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))


def _cells(df: DataFrame, axes: Sequence[str], label: str, by: str, grid: int) -> DataFrame:
    """(by, label, n, centroid, spread) of the points of a cluster in a cell of `grid` steps per axis."""
    ends = df.groupBy(by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("_low", F.min), ("_high", F.max))))
    # One row per model.
    placed = df.join(F.broadcast(ends), by)
    step = lambda a: (F.col(f"_high_{a}") - F.col(f"_low_{a}")) / grid
    cell = lambda a: F.coalesce(F.least(F.floor((F.col(a) - F.col(f"_low_{a}")) / F.nullif(step(a), F.lit(0.0))), F.lit(grid - 1)), F.lit(0))
    held = placed.groupBy(by, label, *(cell(a).alias(f"_at_{a}") for a in axes)).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *((_exact_sum(F.col(a)) / F.count(F.lit(1))).alias(f"_c_{a}") for a in axes),
        (sum((_exact_sum(F.col(a) * F.col(a)) for a in axes), F.lit(0.0)) / F.count(F.lit(1))).alias("_q"),
    )
    spread = F.col("_q") - sum((F.col(f"_c_{a}") * F.col(f"_c_{a}") for a in axes), F.lit(0.0))
    return held.select(by, F.col(label).cast("int").alias("c"), "n", *(F.col(f"_c_{a}") for a in axes), F.greatest(spread, F.lit(0.0)).alias("s"))


def euclidean(df: DataFrame, axes: Sequence[str], label: str = "Cluster", by: str = "K", grid: int = 16) -> DataFrame:
    """One row per `by` value: Silhouette, and the Bound on how far it can be from the exact one.

    At most grid^axes cells per cluster go to the tasks.
    """
    width, schema = len(axes), f"{by} int, low double, high double, n long"
    cells = {}
    for k, rows in _cells(df, axes, label, by, grid).toPandas().groupby(by):
        clusters, at = np.unique(rows["c"], return_inverse=True)
        member = np.zeros((len(rows), len(clusters)))
        member[np.arange(len(rows)), at] = rows["n"]
        cells[int(k)] = (clusters, member, rows[[f"_c_{a}" for a in axes]].to_numpy(float), rows["s"].to_numpy(float))
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def brackets(batches):
        def score(a, b):
            top = np.maximum(a, b)
            return np.divide(b - a, top, out=np.zeros(len(a)), where=top > 0)

        for batch in batches:
            model, cluster = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack([batch.column(2 + i).to_numpy() for i in range(width)], axis=1)
            for k in np.unique(model).tolist():
                clusters, member, center, spread = shared.value[k]
                rows = np.flatnonzero(model == k)
                size = member.sum(axis=0)
                low = high = 0.0
                for part in np.array_split(rows, max(1, len(rows) * len(center) // 2_000_000)):
                    gap = np.zeros((len(part), len(center)))
                    for i in range(width):
                        gap += (x[part, i, None] - center[None, :, i]) ** 2
                    sums = np.sqrt(gap) @ member, np.sqrt(gap + spread) @ member
                    own = np.searchsorted(clusters, cluster[part])
                    at = np.arange(len(part))
                    inside = [s[at, own] / np.maximum(size[own] - 1, 1) for s in sums]
                    outside = []
                    for s in sums:
                        mean = s / size
                        mean[at, own] = np.inf
                        outside.append(mean.min(axis=1))
                    several = (size[own] > 1) & np.isfinite(outside[0])
                    for r, (a, b) in enumerate(((inside[1], outside[0]), (inside[0], outside[1]))):
                        value = np.rint(np.where(several, score(a, np.where(np.isfinite(b), b, 0.0)), 0.0) * 1e12).sum() / 1e12
                        low, high = (low + value, high) if r == 0 else (low, high + value)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((k, pa.int32()), (low, pa.float64()), (high, pa.float64()), (len(rows), pa.int64()))], [by, "low", "high", "n"])

    numbered = df.select(F.col(by).cast("int").alias(by), F.col(label).cast("int").alias(label), *axes)
    total = numbered.mapInArrow(brackets, schema).groupBy(by).agg(_exact_sum(F.col("low")).alias("l"), _exact_sum(F.col("high")).alias("h"), F.sum("n").alias("n"))
    return total.select(by, ((F.col("l") + F.col("h")) / (2 * F.col("n"))).alias("Silhouette"), ((F.col("h") - F.col("l")) / (2 * F.col("n"))).alias("Bound"))


def _blocks(points: int) -> int:
    return max(1, math.ceil(points / _LARGEST_BLOCK), min(_BLOCKS, math.ceil(points / _BLOCK_ROWS)))


def euclidean_exact(df: DataFrame, axes: Sequence[str], label: str = "Cluster", by: str = "K") -> DataFrame:
    """One row per `by` value, exact for any size. Every row needs a label for every `by` value.

    Equal points become one weighted row that carries its label in every model,
    so distances are computed once for all models. Points are dealt to blocks by
    place. A block meets the near boxes of all blocks point by point and the far
    ones at interpolation points, see `distance_sums`: every distance enters
    with a relative error of at most 1e-12. A task holds one block and what the
    block meets; the driver holds the limits of the boxes.
    """
    ks = sorted(r[by] for r in df.select(by).distinct().collect())
    if not ks:
        return df.select(by, F.lit(0.0).alias("Silhouette"))
    labels = [f"c{i}" for i in range(len(ks))]
    points = df.groupBy(*axes).agg(
        (F.count(F.lit(1)) / len(ks)).alias("w"),
        *(F.max(F.when(F.col(by) == k, F.col(label))).alias(c) for k, c in zip(ks, labels)),
    )
    names = [f"x{i}" for i in range(len(axes))]
    points = stage(points.select(*(F.col(a).cast("double").alias(n) for a, n in zip(axes, names)), "w", *(F.col(c).cast("int") for c in labels)))
    sizes = (
        points.select("w", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).alias("c")) for i, c in enumerate(labels)))).alias("e"))
        .groupBy("e.i", "e.c")
        .agg(F.sum("w").alias("n"))
        .orderBy("i", "c")
        .collect()
    )  # one row per model and cluster
    slots = [(r["i"], r["c"]) for r in sizes if r["c"] is not None]
    mass = [r["n"] for r in sizes if r["c"] is not None]
    everything = math.fsum(r["n"] for r in sizes if r["i"] == 0)

    # A point that lacks a coordinate counts in its cluster, but is at no distance from any other, and scores 0.
    placed = F.lit(True)
    for n in names:
        placed &= F.col(n).isNotNull() & ~F.isnan(n)
    points = points.where(placed)

    # Blocks are cut where some of the points, picked by hash, lie evenly. Where that is does not change any result.
    count = points.count()
    some = points.where(F.pmod(F.xxhash64(*names), F.lit(max(1, math.ceil(count / _PLACES)))) == 0).select(*names).toPandas().to_numpy(float)
    tree = distance_sums.cuts(some[np.isfinite(some).all(axis=1)], _blocks(count))
    columns = ", ".join([*(f"{n} double" for n in names), "w double", *(f"{c} int" for c in labels)])
    # Twice as many parts as blocks, as hashing puts some blocks together.
    parts = 2 * (len(tree) + 1)
    dealt = points.mapInPandas(distance_sums.deal(names, tree), f"{columns}, block int").repartition(parts, "block")
    limits = [f"{side}{i}" for side in ("low", "high") for i in range(len(names))]
    schema = f"block int, box int, far boolean, reach double, left int, right int, {', '.join(f'{c} double' for c in limits)}, held binary"
    boxes = stage(dealt.groupBy("block").applyInPandas(distance_sums.lay_out(names, labels, slots), schema))
    known = distance_sums.numbered(boxes.where("far").drop("far", "held").toPandas(), len(names))

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(known)
    blocks = len(known["first"])
    asked = spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(distance_sums.ask(shared), "target int, block int, box int, far boolean")
    sent = asked.join(boxes.select("block", "box", "far", "held"), ["block", "box", "far"]).select(
        F.col("target").alias("block"), F.col("block").alias("other"), "box", "far", "held"
    )
    met = dealt.groupBy("block").cogroup(sent.repartition(parts, "block").groupBy("block"))
    scored = met.applyInPandas(distance_sums.score(shared, names, labels, slots, mass, _TILE), "model int, value double").collect()
    shared.destroy()
    # Not a number, as infinite coordinates give, comes from pandas as null.
    value = lambda r: math.nan if r["value"] is None else r["value"]
    found = [math.fsum(value(r) for r in scored if r["model"] == i) / everything for i in range(len(ks))]
    cells = F.array(*(F.struct(F.lit(k).alias(by), F.lit(v).alias("Silhouette")) for k, v in zip(ks, found)))
    return spark.range(1).select(F.explode(cells).alias("e")).select("e.*")
