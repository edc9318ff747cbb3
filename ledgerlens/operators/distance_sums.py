"""Sums of Euclidean distances from points to all points of each cluster, without a step for every pair.

Points of a block are cut into nested boxes. Between two boxes that lie apart the distance is smooth, so it is
replaced there by its interpolating polynomial in Chebyshev points of one box or of both: the weights of a box's
points move to those few points, sums arrive at those of the other box and are carried on to its own points. An axis
of a box with fewer values than Chebyshev points keeps its values. Boxes that lie close meet point by point.

Every point counts, and every distance enters with a relative error of at most ERROR, rounding aside. Along one axis
of half width h the distance is analytic up to a gap g from the box, hence inside the ellipse with foci at the box's
ends and g as smaller half axis, the sum of whose half axes is r = g/h + sqrt(1 + (g/h)^2) in units of h; there it is
at most 2g + 2h. A polynomial through p Chebyshev points then errs by 4 (2g + 2h) r^(1-p) / (r - 1) at most, and one
axis after the other passes errors on with the Lebesgue constant of p points, at most 1 + 2/pi log(p). A gap counts as
wide enough from APART half widths on; the points per axis follow from that.

The functions travel to the workers by value, so workers need not have this package.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ERROR = 1e-12  # of a distance
APART = 4.0
MOST = 40  # Chebyshev points of an axis
LOST = 64.0  # squared lengths per squared gap for which a product of matrices gives squared distances
LEAF = 256  # points of a box that is not cut any more
_CELLS = 1 << 20  # values of an interpolation matrix held at a time


def error(eta: float, p: int, width: int) -> float:
    """Bound of the relative error of one axis whose gap is `eta` half widths, as all 2 x `width` axes pass it on."""
    rho = eta + np.sqrt(1 + eta * eta)
    passed = sum((1 + 2 / np.pi * np.log(MOST)) ** j for j in range(2 * width))
    # Within two boxes distances differ by this factor at most.
    range_ = 1 + 4 * np.sqrt(width) / APART
    return passed * range_ * 4 * (2 + 2 / eta) * rho ** (1.0 - p) / (rho - 1)


def least_gaps(width: int) -> np.ndarray:
    """Least gap in half widths for which 1, 2, ... MOST points keep the error."""
    found = []
    for p in range(1, MOST + 1):
        low, high = np.log(1e-3), np.log(1e18)
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (low, middle) if error(float(np.exp(middle)), p, width) <= ERROR else (middle, high)
        found.append(float(np.exp(high)))
    return np.array(found)


class Axis:
    """Points of one axis of a box: its own values, or Chebyshev points."""

    def __init__(self, values: np.ndarray, points: int = 0):
        self.points, self.low, self.high = points, values[0], values[-1]
        if points:
            self.unit = np.cos(np.pi * (np.arange(points) + 0.5) / points)
            self.at = np.clip(self._center() + self._half() * self.unit, self.low, self.high)
        else:
            self.at = values

    def _center(self) -> float:
        return self.low / 2 + self.high / 2

    def _half(self) -> float:
        return self.high / 2 - self.low / 2

    def basis(self, x: np.ndarray) -> np.ndarray:
        """(rows, points): what a value at each point adds to the polynomial's value at x."""
        if not self.points:
            return (x[:, None] == self.at[None, :]).astype(float)
        order = np.arange(self.points)
        turn = np.arccos(np.clip((x - self._center()) / self._half(), -1.0, 1.0))
        scale = np.where(order > 0, 2.0, 1.0) / self.points
        return np.cos(turn[:, None] * order) @ (scale[:, None] * np.cos(np.arccos(self.unit)[None, :] * order[:, None]))


class Box:
    def __init__(self, start: int, stop: int, x: np.ndarray, gaps: np.ndarray):
        self.start, self.stop, self.left, self.right = start, stop, -1, -1
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.reach, self.axes, self.leaf = np.inf, None, True
        if not (np.isfinite(self.low).all() and np.isfinite(self.high).all()):
            self.low = self.high = np.full(x.shape[1], np.nan)  # close to everything
            return
        if len(x) <= 2:
            return
        half, axes, reach = self.high / 2 - self.low / 2, [None] * x.shape[1], 0.0
        for i in np.argsort(-half, kind="stable"):
            values = np.unique(x[:, i])
            points = 1 + int(np.argmax(gaps <= APART * max(reach, half[i]) / half[i])) if half[i] > 0 else 1
            kept = len(values) <= points or not (gaps <= APART).any()
            axes[i] = Axis(values, 0 if kept else points)
            reach = reach if kept else max(reach, half[i])
        total = float(np.prod([float(len(a.at)) for a in axes]))
        self.leaf = len(x) <= max(LEAF, total) or not half.any()
        if 2 * total <= len(x):
            self.reach, self.axes = reach, axes

    def points(self) -> np.ndarray:
        return np.stack([g.ravel() for g in np.meshgrid(*(a.at for a in self.axes), indexing="ij")], axis=1)

    def matrices(self, x: np.ndarray):
        """(first row, interpolation matrix) for as many rows of x at a time as fit."""
        step = max(1, _CELLS // int(np.prod([len(a.at) for a in self.axes])))
        for a in range(0, len(x), step):
            out = self.axes[0].basis(x[a : a + step, 0])
            for i in range(1, len(self.axes)):
                more = self.axes[i].basis(x[a : a + step, i])
                out = (out[:, :, None] * more[:, None, :]).reshape(len(out), -1)
            yield a, out


def grown(x: np.ndarray) -> tuple[np.ndarray, list[Box]]:
    """Order of the rows of x by box, and nested boxes: each is cut in the middle of its longest side."""
    order, gaps = np.arange(len(x)), least_gaps(x.shape[1])
    boxes = [Box(0, len(x), x, gaps)]
    open_ = [0]
    while open_:
        box = boxes[open_.pop()]
        if box.leaf:
            continue
        rows = order[box.start : box.stop]
        side = int(np.argmax(box.high / 2 - box.low / 2))
        middle = box.low[side] / 2 + box.high[side] / 2
        lower = x[rows, side] <= (middle if box.low[side] <= middle < box.high[side] else box.low[side])
        order[box.start : box.stop] = np.concatenate([rows[lower], rows[~lower]])
        cut = box.start + int(lower.sum())
        box.left, box.right = len(boxes), len(boxes) + 1
        for a, b in ((box.start, cut), (cut, box.stop)):
            open_.append(len(boxes))
            boxes.append(Box(a, b, x[order[a:b]], gaps))
    return order, boxes


def moved(box: Box, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a box's points (rows, clusters) at its interpolation points."""
    total = 0.0
    for a, matrix in box.matrices(x):
        total = total + matrix.T @ weights[a : a + len(matrix)]
    return total


def meetings(boxes: dict, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (box of the block, other box, whether sums and weights are at interpolation points), each pair of points once.

    `boxes` holds arrays over the boxes of all blocks: low, high, reach, left, right, and `first`, the outermost box
    of each block.
    """
    low, high, reach, left, right = (boxes[k] for k in ("low", "high", "reach", "left", "right"))
    size = (high / 2 - low / 2).max(axis=1)
    s = np.array(boxes["first"])
    t = np.full(len(s), boxes["first"][block])
    done = []
    while len(t):
        gap = np.sqrt((np.maximum(0.0, np.maximum(low[t] - high[s], low[s] - high[t])) ** 2).sum(axis=1))
        far = [np.isfinite(reach[side]) & (gap >= APART * reach[side]) for side in (t, s)]
        ready = [far[i] | (left[side] < 0) for i, side in enumerate((t, s))]
        both = ready[0] & ready[1]
        done.append((t[both], s[both], far[0][both], far[1][both]))
        # The longer one of those that are not ready is cut.
        cut_t = ~ready[0] & (ready[1] | (size[t] >= size[s]))
        cut_s = ~both & ~cut_t
        t, s = (
            np.concatenate([left[t[cut_t]], right[t[cut_t]], t[cut_s], t[cut_s]]),
            np.concatenate([s[cut_t], s[cut_t], left[s[cut_s]], right[s[cut_s]]]),
        )
    return tuple(np.concatenate([d[i] for d in done]) for i in range(4))


def add_distances(total: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, tile: int) -> None:
    """Add the weighted distances from x to y to `total` (rows, clusters), in tiles that stay in a core's cache."""
    low, high = x.min(axis=0), x.max(axis=0)
    center = low / 2 + high / 2
    moved_y = y - center
    norm = (moved_y * moved_y).sum(axis=1)
    gap = (np.maximum(0.0, np.maximum(low - y, y - high)) ** 2).sum(axis=1)
    # |x|^2 - 2xy + |y|^2 loses no digits to speak of where the gap is no small part of the lengths.
    apart = np.isfinite(norm) & (norm + ((high - center) ** 2).sum() <= LOST * gap)
    if apart.any():
        one = x - center
        one = np.concatenate([one, (one * one).sum(axis=1)[:, None], np.ones((len(x), 1))], axis=1)
        two = np.concatenate([-2 * moved_y[apart], np.ones((int(apart.sum()), 1)), norm[apart][:, None]], axis=1)
        _tiles(total, one, two, weights[apart], tile, lambda p, q: p @ q.T)
    if not apart.all():
        _tiles(total, x, y[~apart], weights[~apart], tile, _squares)


def _squares(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    gap = 0.0
    for i in range(one.shape[1]):
        step = np.subtract.outer(one[:, i], two[:, i])
        step *= step
        gap = np.add(gap, step, out=step)
    return gap


def _tiles(total: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, tile: int, squares) -> None:
    for a in range(0, len(x), tile):
        one = x[a : a + tile]
        wide = tile * max(1, tile // len(one))
        for b in range(0, len(y), wide):
            gap = squares(one, y[b : b + wide])
            total[a : a + tile] += np.sqrt(gap, out=gap) @ weights[b : b + wide]


def summed(x: np.ndarray, order: np.ndarray, own: list[Box], boxes: dict, block: int, held: dict, slots: int, tile: int) -> np.ndarray:
    """(rows of x, clusters) sums of distances; `held` has (points, weights) by (box, whether at interpolation points)."""
    first, width = int(boxes["first"][block]), x.shape[1]
    t, s, t_far, s_far = meetings(boxes, block)
    keys = sorted(held)
    ends = np.cumsum([0, *(len(held[k][0]) for k in keys)])
    place = {k: i for i, k in enumerate(keys)}
    points = np.concatenate([held[k][0] for k in keys]).reshape(-1, width)
    weights = np.concatenate([held[k][1] for k in keys]).reshape(-1, slots)
    at = np.array([place[k] for k in zip(s.tolist(), s_far.tolist())])
    total = np.zeros((len(x), slots))
    turn = np.lexsort((at, t_far, t))
    t, t_far, at = t[turn], t_far[turn], at[turn]
    edges = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (t_far[1:] != t_far[:-1])]))
    for a, b in zip(edges, [*edges[1:], len(t)]):
        box = own[int(t[a]) - first]
        rows = order[box.start : box.stop]
        place_of = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in at[a:b]])
        target = box.points() if t_far[a] else x[rows]
        found = np.zeros((len(target), slots))
        step = 1 << 16
        for c in range(0, len(place_of), step):
            some = place_of[c : c + step]
            add_distances(found, target, points[some], weights[some], tile)
        if not t_far[a]:
            total[rows] += found
            continue
        for c, matrix in box.matrices(x[rows]):
            total[rows[c : c + len(matrix)]] += matrix @ found
    return total


def cuts(x: np.ndarray, blocks: int) -> list[tuple[int, float, int, int]]:
    """(axis, value, next if not above, next if above) that deal points like x to about as many blocks.

    A next of -1 - b is block b.
    """
    tree, count = [], 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal count
        best = None
        if parts > 1 and len(rows) > 1:
            for i in np.argsort(-np.ptp(x[rows], axis=0), kind="stable"):
                values = np.sort(x[rows, i])
                for value in (values[(len(values) - 1) // 2], values[max(0, int(np.searchsorted(values, values[len(values) // 2])) - 1)]):
                    below = int(np.searchsorted(values, value, side="right"))
                    uneven = abs(2 * below - len(values))
                    if below < len(values) and (best is None or uneven < best[0] - len(values) / 2):
                        best = (uneven, int(i), float(value), below / len(values))
        if best is None:
            count += 1
            return -count
        here = len(tree)
        tree.append(None)
        lower = x[rows, best[1]] <= best[2]
        some = min(parts - 1, max(1, round(parts * best[3])))
        tree[here] = (best[1], best[2], grow(rows[lower], some), grow(rows[~lower], parts - some))
        return here

    grow(np.arange(len(x)), blocks)
    return tree


def dealt(x: np.ndarray, tree: list) -> np.ndarray:
    """Block of each row."""
    out = np.zeros(len(x), np.int32)
    open_ = [(0, np.arange(len(x)))] if tree else []
    while open_:
        at, rows = open_.pop()
        if at < 0:
            out[rows] = -1 - at
            continue
        axis, value, below, above = tree[at]
        lower = x[rows, axis] <= value
        open_ += [(below, rows[lower]), (above, rows[~lower])]
    return out


def deal(axes: Sequence[str], tree: list):
    """Rows with their block."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(block=dealt(rows[list(axes)].to_numpy(float), tree))

    return work


def _laid(rows: pd.DataFrame, axes: Sequence[str], labels: Sequence[str], slots: Sequence[tuple[int, int]]):
    """Rows in an order of their own, their points, weights by cluster, order by box, and boxes."""
    x = rows[list(axes)].to_numpy(float)
    turn = np.lexsort(x.T)
    rows, x = rows.iloc[turn], x[turn]
    weights = np.zeros((len(x), len(slots)))
    for slot, (i, c) in enumerate(slots):
        weights[:, slot] = rows["w"] * (rows[labels[i]] == c)
    return rows, x, weights, *grown(x)


def lay_out(axes: Sequence[str], labels: Sequence[str], slots: Sequence[tuple[int, int]]):
    """Boxes of a block. A row `far` describes a box and holds its interpolation points, if it has any; another one holds the points of an innermost box."""

    def packed(points: np.ndarray, weights: np.ndarray) -> bytes:
        return np.concatenate([points, weights], axis=1).tobytes()

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        _, x, weights, order, boxes = _laid(rows, axes, labels, slots)
        out = []
        for number, box in enumerate(boxes):
            of = order[box.start : box.stop]
            held = None if box.axes is None else packed(box.points(), moved(box, x[of], weights[of]))
            out.append((block, number, True, box.reach, box.left, box.right, *box.low, *box.high, held))
            if box.leaf:
                out.append((block, number, False, box.reach, box.left, box.right, *box.low, *box.high, packed(x[of], weights[of])))
        sides = [f"{side}{i}" for side in ("low", "high") for i in range(len(axes))]
        return pd.DataFrame(out, columns=["block", "box", "far", "reach", "left", "right", *sides, "held"])

    return work


def numbered(boxes: pd.DataFrame, width: int) -> dict:
    """Rows `far` of `lay_out` as the arrays of `meetings`; `blocks` are the blocks in the order of `first`."""
    boxes = boxes.sort_values(["block", "box"], ignore_index=True)
    first = np.flatnonzero(boxes["box"] == 0)
    start = np.repeat(first, np.diff([*first, len(boxes)]))
    inner = {side: np.where(boxes[side] < 0, -1, boxes[side] + start) for side in ("left", "right")}
    ends = {side: boxes[[f"{side}{i}" for i in range(width)]].to_numpy(float) for side in ("low", "high")}
    return {"reach": boxes["reach"].to_numpy(float), "first": first, "blocks": boxes["block"].to_numpy()[first], **inner, **ends}


def ask(shared):
    """What each block needs: rows (target, block, box, far)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes = shared.value
        for rows in batches:
            for place in rows["id"]:
                _, s, _, s_far = meetings(boxes, int(place))
                asked = np.unique(s * 2 + s_far)
                other = np.searchsorted(boxes["first"], asked // 2, side="right") - 1
                yield pd.DataFrame({"target": boxes["blocks"][place], "block": boxes["blocks"][other], "box": asked // 2 - boxes["first"][other], "far": asked % 2 == 1})

    return work


def score(shared, axes: Sequence[str], labels: Sequence[str], slots: Sequence[tuple[int, int]], mass: Sequence[float], tile: int):
    """Sum of silhouettes of a block, by model."""

    def work(rows: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        boxes = shared.value
        rows, x, _, order, own = _laid(rows, axes, labels, slots)
        block = int(np.searchsorted(boxes["blocks"], rows["block"].iloc[0]))
        held = {}
        for other, box, far, data in zip(sent["other"], sent["box"], sent["far"], sent["held"]):
            values = np.frombuffer(data).reshape(-1, len(axes) + len(slots))
            held[int(boxes["first"][np.searchsorted(boxes["blocks"], other)]) + int(box), bool(far)] = values[:, : len(axes)], values[:, len(axes) :]
        total = summed(x, order, own, boxes, block, held, len(slots), tile)
        weight, out = rows["w"].to_numpy(float), []
        for i, label in enumerate(labels):
            of, value = rows[label].to_numpy(float), np.zeros(len(x))
            mine = [slot for slot, key in enumerate(slots) if key[0] == i]
            for slot in mine:
                member = of == slots[slot][1]
                if mass[slot] <= 1 or len(mine) == 1 or not member.any():
                    continue
                a = total[member, slot] / (mass[slot] - 1)
                b = np.fmin.reduce([total[member, o] / mass[o] for o in mine if o != slot])
                top = np.maximum(a, b)
                value[member] = np.divide(b - a, top, out=np.zeros(len(a)), where=top != 0)
            out.append((i, math.fsum(value * weight)))
        return pd.DataFrame(out, columns=["model", "value"])

    return work
