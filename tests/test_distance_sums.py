"""Sums of distances by boxes, against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import distance_sums, silhouette
from tests.test_models import brute_silhouette

AXES, LABELS, SLOTS = ["x0", "x1", "x2"], ["c0"], [(0, 0), (0, 1), (0, 2)]


def points(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "customers":  # months with one decimal place, counts, money
        return np.stack([np.round(rng.gamma(1.2, 3, n), 1) / 2.5, rng.poisson(1.3, n), rng.gamma(2, 0.7, n)], 1)
    if kind == "line":
        return np.stack([np.ones(n), np.zeros(n), rng.normal(size=n) ** 3], 1)
    if kind == "outliers":
        return np.concatenate([points(n - 9, "customers"), rng.normal(size=(9, 3)) * [1e4, 1e8, 1]])
    if kind == "copies":  # equal as doubles, as far as known only to the caller
        return np.repeat(points(n // 400 + 1, "customers"), 400, axis=0)[:n]
    return np.exp(2 * rng.normal(size=(n, 3)))


class Shared:
    def __init__(self, value):
        self.value = value


def met(x, blocks):
    """Sums by point and cluster as the tasks make them, their points, and how many distances that took."""
    rows = pd.DataFrame(x, columns=AXES).assign(w=1.0, c0=np.arange(len(x)) % 3)
    (rows,) = distance_sums.deal(AXES, distance_sums.cuts(x[::2], blocks))(iter([rows]))
    laid = pd.concat([distance_sums.lay_out(AXES, LABELS, SLOTS)(part) for _, part in rows.groupby("block")])
    boxes = distance_sums.numbered(laid[laid.far].drop(columns=["far", "held"]), 3)
    asked = pd.concat(distance_sums.ask(Shared(boxes))(iter([pd.DataFrame({"id": range(len(boxes["first"]))})])))
    held = {(r.block, r.box, r.far): np.frombuffer(r.held).reshape(-1, 6) for r in laid.itertuples() if r.held is not None}
    xs, sums, steps = [], [], 0
    for place, block in enumerate(boxes["blocks"]):
        _, mine, _, order, own = distance_sums._laid(rows[rows.block == block], AXES, LABELS, SLOTS)
        number = lambda b, o: int(boxes["first"][np.searchsorted(boxes["blocks"], b)]) + o
        sent = {(number(b, o), bool(f)): (held[b, o, f][:, :3], held[b, o, f][:, 3:]) for t, b, o, f in asked.itertuples(index=False) if t == block}
        t, s, t_far, s_far = distance_sums.meetings(boxes, place)
        first = int(boxes["first"][place])
        for a, b, f, g in zip(t.tolist(), s.tolist(), t_far, s_far):
            box = own[a - first]
            steps += (len(box.points()) if f else box.stop - box.start) * len(sent[b, bool(g)][0])
        xs.append(mine)
        sums.append(distance_sums.summed(mine, order, own, boxes, place, sent, 3, 256))
    return np.concatenate(xs), np.concatenate(sums), steps


@pytest.mark.parametrize("kind", ["customers", "line", "outliers", "copies", "any"])
@pytest.mark.parametrize("blocks", [1, 5])
def test_sums_of_distances_equal_those_of_all_pairs(kind, blocks):
    x = points(4000, kind)
    at, sums, steps = met(x, blocks)
    assert sorted(map(tuple, at)) == sorted(map(tuple, x)) and steps <= len(x) ** 2
    some = np.random.default_rng(1).choice(len(at), 200, replace=False)
    gap = np.sqrt(((at[some, None] - x[None]) ** 2).sum(2))
    want = np.stack([gap[:, c::3].sum(1) for c in range(3)], 1)
    assert np.abs(sums[some] / want - 1).max() < 1e-11


def test_every_point_counts_once_in_every_sum():
    # With all points far from a few others, each sum is near the number of points times the distance.
    x = np.concatenate([points(6000, "customers"), np.array([[1e9, 0, 0], [1e9, 1, 0], [1e9, 0, 1]])])
    at, sums, _ = met(x, 4)
    assert sums[at[:, 0] > 1e8].sum(1) == pytest.approx(6000 * 1e9, rel=1e-7)


def test_distances_computed_do_not_grow_with_the_square_of_the_points():
    steps = [met(points(n, "line"), 3)[2] / n**2 for n in (5000, 20_000)]
    assert steps[0] < 0.2 and steps[1] < 0.4 * steps[0]
    steps = [met(points(n, "customers"), 3)[2] / n**2 for n in (20_000, 60_000)]
    assert steps[1] < 0.6 * steps[0]


def test_points_of_an_axis_keep_the_error():
    for width in (1, 2, 3, 5):
        gaps = distance_sums.least_gaps(width)
        assert (np.diff(gaps) < 0).all() and gaps[-1] <= distance_sums.APART
        assert all(distance_sums.error(gap, p, width) <= distance_sums.ERROR for p, gap in enumerate(gaps, start=1))


def test_exact_silhouette_of_several_blocks_and_boxes(spark):
    x = np.concatenate([points(2400, "customers"), points(100, "any")])
    label = np.random.default_rng(2).integers(0, 4, len(x))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(K=4, Cluster=label))
    got = silhouette.euclidean_exact(df, ["a", "b", "c"]).collect()
    assert [r.K for r in got] == [4] and got[0].Silhouette == pytest.approx(brute_silhouette(x, label, False), abs=1e-11)
    again = silhouette.euclidean_exact(df.repartition(7), ["a", "b", "c"]).first()
    assert again.Silhouette == got[0].Silhouette


def test_exact_silhouette_with_missing_coordinates_and_with_one_cluster(spark):
    rows = [(2, float(i * i % 37), 0.0, i * i % 37 % 2) for i in range(40)] + [(2, None, 0.0, 1), (2, 5.0, None, 0), (2, 3.0, 3.0, None)]
    schema = "K int, a double, b double, Cluster int"
    # As in SQL: a distance that is not known adds nothing, the point counts in its cluster and scores 0.
    score = []
    for _, a, b, c in rows:
        if a is None or b is None or c is None:
            score.append(0.0)
            continue
        far = lambda k: sum(((a - p) ** 2 + (b - q) ** 2) ** 0.5 for _, p, q, o in rows if o == k and p is not None and q is not None)
        size = lambda k: sum(o == k for *_, o in rows)
        inside, outside = far(c) / (size(c) - 1), far(1 - c) / size(1 - c)
        score.append((outside - inside) / max(inside, outside))
    got = silhouette.euclidean_exact(spark.createDataFrame(rows, schema), ["a", "b"]).collect()
    assert got[0].Silhouette == pytest.approx(np.mean(score), abs=1e-12)
    one = spark.createDataFrame([(2, float(i), 0.0, 1) for i in range(9)], schema)
    assert silhouette.euclidean_exact(one, ["a", "b"]).collect()[0].Silhouette == 0.0
