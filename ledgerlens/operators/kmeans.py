"""K-means over many groups, cluster counts and restarts at once.

All fits advance together, whatever the size of the groups. Starting centers come from k-means||: a few passes
draw candidates with odds proportional to weight and squared distance, and the driver picks k of them by weight.
Then one job per Lloyd iteration reads every point once, meets it with the centers of all unfinished fits as one
matrix, and adds up per task what it finds; only centers and candidates (fits x k rows) come back to the driver.

Draws are hashes of the points and sums are whole numbers of a fixed fraction, so neither depends on how rows are
dealt. Distances are not bounded from pass to pass: with three features and ten centers they are quicker to
compute than bounds are to read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.config import FEATURES
from ledgerlens.operators import batch_sums
from ledgerlens.session import stage

_FAR = 1e150  # coordinate of a padding center: never the nearest one
_ROUNDS = 3  # of drawing candidates, 2 k of them each
_EXACT = "decimal(38,12)"


@dataclass
class ClusterModel:
    """One fitted grouping: scaled centers with the scaling that belongs to them."""

    group: object
    k: int
    mean: np.ndarray
    std: np.ndarray
    centers: np.ndarray
    cost: float = float("nan")

    def raw_centers(self) -> np.ndarray:
        return self.centers * self.std + self.mean


def scaling(df: DataFrame, group: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and population deviation per group; a constant feature gets deviation 1."""
    count = F.count(F.lit(1))
    exact = lambda value: F.sum(value.cast(_EXACT)).cast("double")
    means = df.groupBy(group).agg(count.alias("Rows"), *((exact(F.col(f)) / F.count(f)).alias(f"Mean_{f}") for f in features))
    # One row per group on the right.
    gaps = df.join(F.broadcast(means), group)
    gap = lambda f: F.col(f) - F.col(f"Mean_{f}")
    spread = gaps.groupBy(group).agg(*(F.sqrt(exact(gap(f) * gap(f)) / F.count(f)).alias(f"Std_{f}") for f in features))
    fixed = {f"Std_{f}": F.when(F.col(f"Std_{f}") > 0, F.col(f"Std_{f}")).otherwise(1.0) for f in features}
    return means.join(F.broadcast(spread), group).withColumns(fixed)


def fit(
    df: DataFrame,
    group: str,
    k_values: Sequence[int],
    n_init: int = 10,
    seed: int = 42,
    max_iter: int = 300,
    tol: float = 1e-4,
    features: Sequence[str] = FEATURES,
    spare_rows: int = 0,
) -> list[ClusterModel]:
    """Best of `n_init` restarts per group and k.

    A group with fewer than k + `spare_rows` rows gets no fit for that k.
    """
    stats = {
        r[group]: (
            r["Rows"],
            np.array([r[f"Mean_{f}"] for f in features]),
            np.array([r[f"Std_{f}"] for f in features]),
        )
        for r in scaling(df, group, features).collect()
    }
    plan = [
        (g, k, init)
        for g in sorted(stats, key=str)
        for k in k_values
        if stats[g][0] >= k + spare_rows
        for init in range(n_init)
    ]
    if not plan:
        return []
    points, numbers = _weighted_points(df, group, stats, features)
    runs = [{"group": g, "number": numbers[g], "k": k, "init": init} for g, k, init in plan]
    _place_seeds(points, runs, seed, len(features))
    _run_together(points, runs, max_iter, tol, len(features))
    best: dict[tuple, dict] = {}
    for run in runs:
        key = (run["group"], run["k"])
        if key not in best or run["cost"] < best[key]["cost"]:
            best[key] = run
    return [
        ClusterModel(g, k, stats[g][1], stats[g][2], run["centers"], run["cost"])
        for (g, k), run in sorted(best.items(), key=lambda item: (str(item[0][0]), item[0][1]))
    ]


def from_centers(
    df: DataFrame, group: str, centers: np.ndarray | dict, steps: int, features: Sequence[str] = FEATURES
) -> list[ClusterModel]:
    """Models after a fixed number of steps from given centers in raw units, for every group of `df`.

    `centers` are those of all groups, or a mapping from group to centers.
    """
    starts = lambda g: np.asarray(centers[g] if isinstance(centers, dict) else centers, float)
    stats = {
        r[group]: (r["Rows"], np.array([r[f"Mean_{f}"] for f in features]), np.array([r[f"Std_{f}"] for f in features]))
        for r in scaling(df, group, features).collect()
    }
    if not stats:
        return []
    points, numbers = _weighted_points(df, group, stats, features)
    runs = [
        {"group": g, "number": numbers[g], "k": len(starts(g)), "centers": (starts(g) - stats[g][1]) / stats[g][2]}
        for g in sorted(stats, key=str)
    ]
    for _ in range(steps):
        _advance(points, runs, len(features))
    _advance(points, runs, len(features), move=False)
    return [ClusterModel(r["group"], r["k"], *stats[r["group"]][1:], r["centers"], r["cost"]) for r in runs]


def _weighted_points(df: DataFrame, group: str, stats: dict, features: Sequence[str]) -> tuple[DataFrame, dict]:
    """Distinct scaled points (_g, _w, _x0, ...) with their row counts, staged once for all iterations, and the
    number `_g` of each group.

    Idle customers are all the same point; as one weighted row they cost nothing.
    """
    distinct = df.groupBy(group, *features).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    numbers = {g: i for i, g in enumerate(stats)}
    scale = small_table(
        df,
        {
            group: list(stats),
            "_g": np.arange(len(stats), dtype=np.int32),
            **{f"_m{i}": [float(s[1][i]) for s in stats.values()] for i in range(len(features))},
            **{f"_s{i}": [float(s[2][i]) for s in stats.values()] for i in range(len(features))},
        },
    )
    scaled = distinct.join(F.broadcast(scale), group).select(
        "_g",
        "_w",
        *(((F.col(f) - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(f"_x{i}") for i, f in enumerate(features)),
    )
    # Every pass computes much per point, so points are spread even where they are few bytes.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(scaled.repartition(parts, *(f"_x{i}" for i in range(len(features))))), numbers


def small_table(df: DataFrame, columns: dict) -> DataFrame:
    """Driver values as a table; through Arrow, so that no Python task is needed."""
    return df.sparkSession.createDataFrame(pa.table(columns))


def _by_number(runs: list[dict]) -> dict[int, list[dict]]:
    """Runs of each group, in the order in which their centers are stacked."""
    out: dict[int, list[dict]] = {}
    for run in runs:
        out.setdefault(run["number"], []).append(run)
    return out


def _stacked(rows: Sequence[np.ndarray], width: int) -> np.ndarray:
    """(runs, most rows, axes); places that a run does not have are too far to be the nearest."""
    out = np.full((len(rows), max(len(r) for r in rows), width), _FAR)
    for place, r in zip(out, rows):
        place[: len(r)] = r
    return out


def _key(run: dict, seed: int, number: int) -> int:
    return int(np.random.SeedSequence([seed, run["k"], run["init"], number]).generate_state(1, np.uint64)[0])


def _place_seeds(points: DataFrame, runs: list[dict], seed: int, width: int) -> None:
    """Starting centers of every run."""
    groups = _by_number(runs)
    found = {id(run): [] for run in runs}
    for number in range(_ROUNDS + 1):
        keys = {g: np.array([_key(run, seed, number) for run in of], np.uint64) for g, of in groups.items()}
        chosen = {g: _stacked([np.array(found[id(run)]) for run in of], width) if number else None for g, of in groups.items()}
        many = 2 * max(run["k"] for run in runs) if number else 1
        race = points.mapInArrow(batch_sums.drawn(keys, chosen, many, width), "g int, r int, t double, c array<double>")
        # The tasks' first ones, of which the first go on.
        won = race.groupBy("g", "r").agg(F.slice(F.array_sort(F.collect_list(F.struct("t", "c"))), 1, many).alias("first"))
        for row in won.collect():
            run = groups[row.g][row.r]
            found[id(run)] += [tuple(e.c) for e in row.first[: 2 * run["k"] if number else 1]]
    candidates = {id(run): np.array(sorted(set(found[id(run)]))) for run in runs}
    for run, mass in zip(runs, _masses(points, runs, candidates, width)):
        x, random = candidates[id(run)], np.random.default_rng([seed, run["k"], run["init"]])
        run["centers"] = _settled(x, mass, _spread_seeds(x, mass, run["k"], random))


def _masses(points: DataFrame, runs: list[dict], centers: dict[int, np.ndarray], width: int) -> list[np.ndarray]:
    out = {id(run): np.zeros(len(centers[id(run)])) for run in runs}
    for run, place, row in _passed(points, runs, centers, width):
        out[id(run)][place] = row["mass"]
    return [out[id(run)] for run in runs]


def _passed(points: DataFrame, runs: list[dict], centers: dict[int, np.ndarray], width: int):
    """One pass over the points: (run, center, sums) wherever points are nearest to a center."""
    groups = _by_number(runs)
    stacked = {g: _stacked([centers[id(run)] for run in of], width) for g, of in groups.items()}
    names = batch_sums.names(width)
    schema = ", ".join(f"{n} {'int' if n in ('g', 'place') else 'long'}" for n in names)
    partial = points.mapInArrow(batch_sums.sums(stacked, width), schema)
    total = partial.groupBy("g", "place").agg(*(F.sum(n).alias(n) for n in names[2:]))
    for row in total.toArrow().to_pylist():
        number, place = divmod(row["place"], stacked[row["g"]].shape[1])
        yield groups[row["g"]][number], place, row


def _settled(x: np.ndarray, w: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Centers after some steps among the candidates alone."""
    for _ in range(20):
        label = _distances(x, centers).argmin(1)
        mass = np.bincount(label, w, len(centers))
        sums = np.stack([np.bincount(label, w * column, len(centers)) for column in x.T], 1)
        filled = mass > 0
        centers = centers.copy()
        centers[filled] = sums[filled] / mass[filled, None]
    return centers


def _run_together(points: DataFrame, runs: list[dict], max_iter: int, tol: float, width: int) -> None:
    """All restarts in lockstep, one pass over the points per iteration."""
    moving = list(runs)
    for _ in range(max_iter):
        if not moving:
            break
        moving = [run for run in _advance(points, moving, width) if run["shift"] > tol]
    _advance(points, runs, width, move=False)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centers)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - centers[None, :, i]) ** 2
    return out


def _spread_seeds(x: np.ndarray, w: np.ndarray, k: int, rng) -> np.ndarray:
    """k starting rows, each drawn with odds proportional to its squared distance
    from the rows already taken; the best of a few draws is kept."""
    chosen = [x[rng.choice(len(x), p=w / w.sum())]]
    near = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        mass = near * w
        odds = mass / mass.sum() if mass.sum() > 0 else w / w.sum()
        tries = x[rng.choice(len(x), size=2 + int(np.log(k)), p=odds)]
        reach = np.minimum(near[:, None], _distances(x, tries))
        pick = int((w @ reach).argmin())
        chosen.append(tries[pick])
        near = reach[:, pick]
    return np.array(chosen)


def _advance(points: DataFrame, runs: list[dict], width: int, move: bool = True) -> list[dict]:
    """One pass over the points: new centers, their shift and the cost, per run."""
    # An empty cluster keeps its center.
    moved = {id(run): run["centers"].copy() for run in runs}
    cost = {id(run): [0, 0] for run in runs}
    for run, place, row in _passed(points, runs, {id(run): run["centers"] for run in runs}, width):
        center = [batch_sums.joined(row[f"whole{i}"], row[f"fine{i}"]) / row["mass"] for i in range(width)]
        moved[id(run)][place] = center
        cost[id(run)][0] += row["cost_whole"]
        cost[id(run)][1] += row["cost_fine"]
    for run in runs:
        run["cost"] = batch_sums.joined(*cost[id(run)])
        if move:
            run["shift"] = float(((moved[id(run)] - run["centers"]) ** 2).sum())
            run["centers"] = moved[id(run)]
    return runs


def _squared(x: Sequence[Column], c: Sequence[Column]) -> Column:
    parts = [(a - b) * (a - b) for a, b in zip(x, c)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _nearest(df: DataFrame, k: int) -> DataFrame:
    """Add `_best` and `_cluster` from distances `_d0` .. `_d{k-1}`; the lower number wins a tie."""
    best = F.least(*(F.col(f"_d{j}") for j in range(k))) if k > 1 else F.col("_d0")
    cluster = F.when(F.col("_d0") == F.col("_best"), 0)
    for j in range(1, k):
        cluster = cluster.when(F.col(f"_d{j}") == F.col("_best"), j)
    return df.withColumn("_best", best).withColumn("_cluster", cluster).drop(*(f"_d{j}" for j in range(k)))


def assign(
    df: DataFrame, group: str | None, models: Sequence[ClusterModel], features: Sequence[str] = FEATURES
) -> DataFrame:
    """Add Cluster, and the scaled features as `_x0`, `_x1`, ...

    With `group` each row meets the models of its group through a broadcast of
    one row per model; rows of a group without a model drop out. With
    `group=None` there is one model for all rows and its numbers are literals.
    """
    width = len(features)
    if group is None:
        (model,) = models
        k = model.k
        number = lambda values, i: F.lit(float(values[i]))
        placed, mean, std = df, model.mean, model.std
        scaled = [(F.col(f) - number(mean, i)) / number(std, i) for i, f in enumerate(features)]
        center = lambda j, i: F.lit(float(model.centers[j][i]))
    else:
        k = max(m.k for m in models)
        table = small_table(
            df,
            {
                group: [m.group for m in models],
                "K": [m.k for m in models],
                **{f"_m{i}": [float(m.mean[i]) for m in models] for i in range(width)},
                **{f"_s{i}": [float(m.std[i]) for m in models] for i in range(width)},
                **{
                    f"_c{j * width + i}": [float(m.centers[j][i]) if j < m.k else _FAR for m in models]
                    for j in range(k)
                    for i in range(width)
                },
            },
        )
        placed = df.join(F.broadcast(table), group)
        scaled = [(F.col(f) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, f in enumerate(features)]
        center = lambda j, i: F.col(f"_c{j * width + i}")
    helpers = [c for c in placed.columns if c.startswith(("_m", "_s", "_c"))]
    placed = placed.withColumns({f"_x{i}": x for i, x in enumerate(scaled)})
    axes = [F.col(f"_x{i}") for i in range(width)]
    placed = placed.withColumns(
        {f"_d{j}": _squared(axes, [center(j, i) for i in range(width)]) for j in range(k)}
    ).drop(*helpers)
    return _nearest(placed, k).withColumnRenamed("_cluster", "Cluster").drop("_best")
