import os
import subprocess
import sys
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import FEATURES, GRADE_NAMES, RetailConfig
from ledgerlens.operators import grades, kmeans, predict, silhouette

CFG = RetailConfig(n_init=4)


def table(spark, n=240, groups=2, seed=0):
    rng = np.random.default_rng(seed)
    spots = np.array([[7, 0, 0], [1, 2, 300], [3, 1, 100], [0.5, 5, 900], [5, 3, 500]], float)
    x = spots[rng.integers(0, 5, n)] + rng.normal(0, 0.2, (n, 3)) * [1, 1, 30]
    pdf = pd.DataFrame(x, columns=list(FEATURES)).assign(CustomerID=[str(i) for i in range(n)], g=rng.integers(0, groups, n))
    pdf.loc[pdf.index % 3 == 0, list(FEATURES)] = [7.0, 0.0, 0.0]  # a third are copies of one point
    return pdf, spark.createDataFrame(pdf)


def test_rows_sit_at_their_nearest_center_and_centers_are_means(spark):
    pdf, df = table(spark)
    models = kmeans.fit(df, "g", [5], n_init=4, tol=1e-12)
    assert [m.group for m in models] == [0, 1]
    placed = kmeans.assign(df, "g", models).toPandas()
    for m in models:
        rows = placed[placed.g == m.group]
        raw = rows[list(FEATURES)].to_numpy()
        assert m.mean == pytest.approx(raw.mean(0)) and m.std == pytest.approx(raw.std(0))
        x = (raw - raw.mean(0)) / raw.std(0)
        gap = ((x[:, None] - m.centers[None]) ** 2).sum(2)
        assert (gap.argmin(1) == rows.Cluster).all()
        assert m.cost == pytest.approx(gap.min(1).sum(), rel=1e-6)
        for j in range(5):
            assert m.centers[j] == pytest.approx(x[rows.Cluster == j].mean(0), abs=1e-5)


def test_the_fit_does_not_depend_on_how_rows_are_dealt(spark):
    _, df = table(spark)
    labels = []
    for parts in (1, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            models = kmeans.fit(df.repartition(parts, "CustomerID"), "g", [5], n_init=4)
            placed = kmeans.assign(df, "g", models).toPandas().sort_values("CustomerID")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        labels.append((list(placed.Cluster), [m.cost for m in models], [m.centers.tolist() for m in models]))
    assert labels[0] == labels[1]


def test_the_fit_finds_well_separated_spots(spark):
    _, df = table(spark, groups=1)
    models = kmeans.fit(df, "g", [5], n_init=6)
    assert sorted(len(part) for _, part in kmeans.assign(df, "g", models).toPandas().groupby("Cluster"))[0] >= 10
    assert models[0].cost < 12


FROM_ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from ledgerlens.operators import kmeans
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = [(0, float(i % 3), float(i % 3), float(i)) for i in range(12)]
df = spark.createDataFrame(rows, "g int, Recency double, Frequency double, Monetary double")
print("rows", kmeans.assign(df, "g", kmeans.fit(df, "g", [2], n_init=2)).count())
"""


def test_the_fit_runs_from_another_folder_in_a_fresh_process(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", FROM_ELSEWHERE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 12" in run.stdout, run.stderr[-2000:]


def test_more_clusters_than_grade_names_raise():
    model = kmeans.ClusterModel(0, 6, np.zeros(3), np.ones(3), np.zeros((6, 3)))
    with pytest.raises(ValueError):
        grades.grade_of_cluster(model, GRADE_NAMES)


def test_more_restarts_never_cost_more(spark):
    _, df = table(spark, groups=1)
    one = kmeans.fit(df, "g", [4], n_init=1)[0].cost
    assert kmeans.fit(df, "g", [4], n_init=6)[0].cost <= one + 1e-9


def test_small_constant_and_empty_tables(spark):
    schema = "g int, CustomerID string, Recency double, Frequency double, Monetary double"
    flat = spark.createDataFrame([(0, str(i), 7.0, 0.0, 0.0) for i in range(6)], schema)
    model = kmeans.fit(flat, "g", [5])[0]
    assert model.cost == 0.0 and kmeans.assign(flat, "g", [model]).count() == 6
    assert kmeans.fit(flat.limit(3), "g", [5]) == []
    assert kmeans.fit(flat.where("false"), "g", [5]) == []
    none = grades.apply_grades(flat, [], GRADE_NAMES)
    assert none.count() == 0 and none.columns[-2:] == ["Cluster", "Customer_Grade"]


def test_months_with_too_few_rows_drop_out(spark):
    _, df = table(spark, 40, groups=1)
    short = df.limit(3).withColumn("g", F.lit(9).cast("long"))
    both = df.unionByName(short)
    models = kmeans.fit(both, "g", [5], n_init=2)
    assert [m.group for m in models] == [0]
    assert grades.apply_grades(both, models, GRADE_NAMES, "g").count() == 40


def test_grades_follow_money_then_frequency_then_recency():
    centers = np.array([[1, 1, 5], [9, 1, 5], [1, 0, 5], [0, 0, 1], [0, 0, 9]], float)
    model = kmeans.ClusterModel(0, 5, np.zeros(3), np.ones(3), centers)
    want = {3: 0, 2: 1, 1: 2, 0: 3, 4: 4}
    assert grades.grade_of_cluster(model, GRADE_NAMES) == [GRADE_NAMES[want[j]] for j in range(5)]


def brute_silhouette(x, label, square):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if square:
        gap = gap**2
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = gap[i][own].sum() / (own.sum() - 1)
        b = min(gap[i][label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block", [4000, 25])
def test_silhouette_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(silhouette, "_BLOCK_ROWS", block)
    pdf, df = table(spark, 130)
    models = kmeans.fit(df.withColumn("g", F.lit(0)), "g", [2, 4], n_init=2)
    placed = kmeans.assign(df.withColumn("g", F.lit(0)), "g", models)
    axes = ["_x0", "_x1", "_x2"]
    rows = placed.toPandas()
    for fn, square in ((silhouette.euclidean_exact, False), (silhouette.squared, True)):
        got = dict(fn(placed, axes).collect())
        for k, part in rows.groupby("K"):
            assert got[k] == pytest.approx(brute_silhouette(part[axes].to_numpy(), part.Cluster.to_numpy(), square), abs=1e-9)


@pytest.mark.parametrize("seed", [0, 1])
def test_silhouette_from_cells_is_within_its_bound(spark, seed):
    pdf, df = table(spark, 160, seed=seed)
    axes = ["_x0", "_x1", "_x2"]
    one = df.withColumn("g", F.lit(0))
    placed = kmeans.assign(one, "g", kmeans.fit(one, "g", [2, 3, 5], n_init=2))
    rows = placed.toPandas()
    exact = {k: brute_silhouette(part[axes].to_numpy(), part.Cluster.to_numpy(), False) for k, part in rows.groupby("K")}
    bounds = []
    for grid in (2, 8, 64):
        got = {r.K: r for r in silhouette.euclidean(placed, axes, grid=grid).collect()}
        for k, want in exact.items():
            assert abs(got[k].Silhouette - want) <= got[k].Bound + 1e-9
        bounds.append(max(r.Bound for r in got.values()))
    assert bounds[0] > bounds[1] > bounds[2] and bounds[2] < 0.01
    assert silhouette.euclidean(placed.where("false"), axes).collect() == []


def test_points_that_differ_stay_apart_in_the_exact_silhouette(spark):
    rows = [(2, float(x), 0.0, 0.0, x % 2) for x in range(40)] * 2
    df = spark.createDataFrame(rows, "K int, x double, y double, z double, Cluster int")
    got = dict(silhouette.euclidean_exact(df, ["x", "y", "z"]).collect())
    x = np.array([r[1:4] for r in rows])
    assert got[2] == pytest.approx(brute_silhouette(x, np.array([r[4] for r in rows]), False))


def test_sums_are_the_same_in_any_order():
    from ledgerlens.operators import batch_sums

    rng = np.random.default_rng(5)
    x, w = rng.normal(0, 50, (9000, 3)), rng.integers(1, 10**7, 9000).astype(float)
    centers = {0: rng.normal(0, 50, (4, 3, 3))}

    def total(order, size):
        batches = []
        for a in range(0, len(order), size):
            rows = order[a : a + size]
            arrays = [np.zeros(len(rows), np.int32), w[rows], *x[rows].T]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], list("gwxyz")))
        (out,) = batch_sums.sums(centers, 3)(iter(batches))
        return {(r["place"]): (r["mass"], *(r[f"whole{i}"] + r[f"fine{i}"] / 2**30 for i in range(3))) for r in out.to_pylist()}, out.to_pylist()

    first, rows = total(np.arange(9000), 9000)
    again, shuffled = total(rng.permutation(9000), 700)
    assert sorted(map(str, rows)) == sorted(map(str, shuffled)) and first == again
    gap = ((x[:, None, None] - centers[0][None]) ** 2).sum(3)
    for run in range(4):
        for j in range(3):
            own = gap[:, run].argmin(1) == j
            if own.any():
                assert first[run * 3 + j] == pytest.approx((w[own].sum(), *(w[own, None] * x[own]).sum(0)), rel=1e-9)


def test_k_sweep_skips_k_without_spare_rows(spark):
    _, df = table(spark, 4, groups=1, seed=2)
    got = grades.evaluate_k(df, CFG).toPandas()
    assert sorted(got.k) == [2, 3] and set(got.Distance) == {"squared"}
    assert grades.evaluate_k(df.limit(1), CFG).count() == 0
    with pytest.raises(ValueError):
        grades.evaluate_k(df, CFG, "cosine")


def snapshots(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "CustomerID": [str(i) for i in range(n)],
            "BaseMonth": [date(2011, 1 + i % 10, 1) for i in range(n)],
            "WindowMonths": rng.choice([3, 6], n),
            "Recency": np.round(rng.random(n) * 6, 1),
            "Frequency": rng.integers(1, 6, n),
            "Monetary": rng.random(n) * 1000,
        }
    )
    odds = 1 / (1 + np.exp(pdf.Recency - 0.4 * pdf.Frequency))
    pdf["TargetBuyNextMonth"] = (rng.random(n) < odds).astype(int)
    pdf["BaseMonthStr"] = [f"{d:%Y-%m}" for d in pdf.BaseMonth]
    return pdf, spark.createDataFrame(pdf).withColumn("TargetBuyNextMonth", F.col("TargetBuyNextMonth").cast("int"))


def newton(x, y, c=1.0):
    """Solution of the weighted L2 logistic objective, intercept unpenalised."""
    n = len(y)
    w = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    z = np.c_[x, np.ones(n)]
    pen = np.diag([1.0] * x.shape[1] + [0.0]) / c
    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        grad = z.T @ (w * (p - y)) + pen @ b
        b -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + pen, grad)
    return b


def test_logistic_model_solves_the_balanced_objective(spark):
    pdf, df = snapshots(spark)
    counts = pdf.TargetBuyNextMonth.value_counts().to_dict()
    model = predict.fit_logistic(df, counts)
    want = newton(pdf[list(FEATURES)].to_numpy(), pdf.TargetBuyNextMonth.to_numpy())
    assert [*model.coefficients, model.intercept] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_all_widths_are_fitted_by_few_passes(spark):
    pdf, df = snapshots(spark, 600, 3)
    counts = {int(w): part.TargetBuyNextMonth.value_counts().to_dict() for w, part in pdf.groupby("WindowMonths")}
    models = predict.fit_logistic_by(df, counts, c=0.3)
    assert sorted(models) == [3, 6]
    for w, part in pdf.groupby("WindowMonths"):
        want = newton(part[list(FEATURES)].to_numpy(), part.TargetBuyNextMonth.to_numpy(), 0.3)
        assert [*models[w].coefficients, models[w].intercept] == pytest.approx(want, rel=1e-8, abs=1e-10)
        assert models[w].passes < 10


def test_separable_and_constant_features_still_have_a_model(spark):
    rows = [(3, 1.0, 0.0 + i, 5.0, int(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "WindowMonths int, Recency double, Frequency double, Monetary double, TargetBuyNextMonth int")
    model = predict.fit_logistic_by(df, {3: {0: 10, 1: 10}})[3]
    x = np.array([r[1:4] for r in rows])
    assert [*model.coefficients, model.intercept][1] == pytest.approx(newton(x[:, 1:2], np.array([r[4] for r in rows]))[0], rel=1e-6)


def pair_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()


def test_auc_counts_pairs_with_ties_half(spark):
    pdf, df = snapshots(spark)
    got = predict.auc(df.withColumn("PredProb", F.floor(-F.col("Recency"))), ["BaseMonthStr"]).toPandas()
    for r in got.itertuples():
        part = pdf[pdf.BaseMonthStr == r.BaseMonthStr]
        assert r.AUC == pytest.approx(pair_auc(part.TargetBuyNextMonth.to_numpy(), np.floor(-part.Recency.to_numpy())))
        assert r.N == len(part) and r.PositiveRate == pytest.approx(part.TargetBuyNextMonth.mean())
    one = predict.auc(df.where("TargetBuyNextMonth = 1").withColumn("PredProb", -F.col("Recency")), ["WindowMonths"])
    assert one.where("AUC is not null").count() == 0 and one.count() == 2


def test_window_report_and_degenerate_splits(spark):
    pdf, df = snapshots(spark)
    report = predict.evaluate_windows(df, [3, 6, 12], date(2011, 7, 1))
    summary = report.summary.toPandas().set_index("WindowMonths")
    late = pdf.BaseMonth >= date(2011, 7, 1)
    for w in (3, 6):
        mine = pdf.WindowMonths == w
        assert tuple(summary.loc[w, ["TrainN", "TestN"]]) == ((mine & ~late).sum(), (mine & late).sum())
        scored = report.scored.where(f"WindowMonths = {w}").toPandas()
        assert summary.OverallAUC[w] == pytest.approx(pair_auc(scored.TargetBuyNextMonth.to_numpy(), scored.PredProb.to_numpy()))
    assert np.isnan(summary.OverallAUC[12]) and summary.TrainN[12] == 0
    assert report.monthly.count() == 8
    only = df.withColumn("TargetBuyNextMonth", F.lit(1))
    empty = predict.evaluate_windows(only, [3], date(2011, 7, 1))
    assert empty.monthly.count() == 0 and empty.summary.first().OverallAUC is None
    assert empty.scored.where("PredProb is not null").count() == 0 and empty.scored.count() > 0


def test_exact_silhouette_copies_no_more_rows_than_tasks_need(spark, monkeypatch):
    assert [silhouette._blocks(n) for n in (0, 1, 2000, 9000, 90_000, 900_000)] == [1, 1, 1, 5, 32, 45]
    r = np.random.default_rng(5)
    x, label = r.normal(size=(300, 2)), r.integers(0, 3, 300)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = lambda c: gap[:, label == c].sum(1) / np.where(label == c, (label == c).sum() - 1, (label == c).sum())
    means = np.stack([mean(c) for c in range(3)], 1)
    own = means[np.arange(300), label]
    means[np.arange(300), label] = np.inf
    other = means.min(1)
    df = spark.createDataFrame([(1, float(a), float(b), int(c)) for (a, b), c in zip(x, label)], "K int, a double, b double, Cluster int")
    # Tiles that do not fit evenly.
    monkeypatch.setattr(silhouette, "_TILE", 64)
    assert silhouette.euclidean_exact(df, ["a", "b"]).first()["Silhouette"] == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-12)
