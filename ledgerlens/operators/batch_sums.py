"""What the tasks of a K-means pass compute: one row per point comes in, sums per run and cluster go out.

The centers of all runs of a group are one matrix, so a batch of points meets every run at once. Sums are kept in
whole numbers and 2**-30 parts of one, which add up alike in any order. The functions travel to the workers by
value, so workers need not have this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINE = 30  # bits of a fraction
ROWS = 4096  # points that meet all centers at a time


def split(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.rint(value)
    return whole, np.rint((value - whole) * 2.0**FINE)


def joined(whole: int, fine: int) -> float:
    return ((int(whole) << FINE) + int(fine)) / (1 << FINE)


def gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(points, runs, centers) squared distances for centers (runs, centers, axes)."""
    out = None
    for i in range(x.shape[1]):
        gap = x[:, i, None, None] - centers[None, :, :, i]
        out = gap * gap if out is None else out + gap * gap
    return out


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, weights, points) of at most ROWS points."""
    for batch in batches:
        group, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = np.stack([batch.column(2 + i).to_numpy() for i in range(width)], axis=1)
        for g in np.unique(group).tolist():
            of = np.flatnonzero(group == g)
            for a in range(0, len(of), ROWS):
                rows = of[a : a + ROWS]
                yield g, weight[rows], x[rows]


def sums(centers: dict[int, np.ndarray], width: int):
    """Mass, coordinates and cost by group and by place among its runs x centers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for g, weight, x in _groups(batches, width):
            if g not in centers:
                continue
            runs, k, _ = centers[g].shape
            far = gaps(x, centers[g])
            place = (far.argmin(axis=2) + np.arange(runs) * k).ravel()
            each = lambda v: np.broadcast_to(v[:, None], (len(v), runs)).ravel()
            values = [each(weight)]
            for i in range(width):
                values += [each(part) for part in split(weight * x[:, i])]
            values += [part.ravel() for part in split(weight[:, None] * far.min(axis=2))]
            found = np.stack([np.bincount(place, v, runs * k) for v in values]).astype(np.int64)
            if g not in total:
                total[g] = np.zeros_like(found)
            total[g] += found
            # Fractions that make a whole one move up.
            fine = total[g][2::2]
            total[g][1::2] += fine >> FINE
            total[g][2::2] = fine & (1 << FINE) - 1
        for g, found in total.items():
            met = np.flatnonzero(found[0])
            columns = [pa.array(np.full(len(met), g, np.int32)), pa.array(met.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(row[met]) for row in found)], names(width))

    return work


def names(width: int) -> list[str]:
    parts = [f"{part}{i}" for i in range(width) for part in ("whole", "fine")]
    return ["g", "place", "mass", *parts, "cost_whole", "cost_fine"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def luck(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(points, runs) draws from (0, 1] that depend on the point and the run's key alone."""
    h = np.zeros(len(x), np.uint64)
    for i in range(x.shape[1]):
        h = _mixed(h + (x[:, i] + 0.0).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((_mixed(h[:, None] ^ keys[None, :]) >> np.uint64(11)).astype(float) + 1) * 2.0**-53


def drawn(keys: dict[int, np.ndarray], chosen: dict[int, np.ndarray | None], many: int, width: int):
    """For every group and run the `many` points that come first in a race with odds by weight and, where points
    are chosen already, squared distance from these."""

    def first(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((*x.T[::-1], t))[:many]
        order = order[np.isfinite(t[order])]
        return t[order], x[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for g, weight, x in _groups(batches, width):
            if g not in keys:
                continue
            odds = weight[:, None]
            if chosen[g] is not None:
                odds = odds * gaps(x, chosen[g]).min(axis=2)
            with np.errstate(divide="ignore"):
                wait = -np.log(luck(x, keys[g])) / odds
            for r in range(len(keys[g])):
                t = wait[:, r]
                rows = np.argpartition(t, many)[: many + 1] if len(t) > many + 1 else np.arange(len(t))
                # Ties beyond the last place are kept until coordinates decide.
                rows = np.flatnonzero(t <= t[rows].max()) if len(rows) < len(t) else rows
                old = best.get((g, r))
                both = (t[rows], x[rows]) if old is None else (np.append(old[0], t[rows]), np.concatenate([old[1], x[rows]]))
                best[g, r] = first(*both)
        for (g, r), (t, points) in best.items():
            columns = [np.full(len(t), g, np.int32), np.full(len(t), r, np.int32), t]
            axes = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), axes], ["g", "r", "t", "c"])

    return work
