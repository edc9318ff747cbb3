"""Next-purchase model and ROC-AUC.

The logistic models of all window widths are fitted together by Newton steps: one aggregate over the rows, grouped
by width, gives the gradients and second derivatives of all of them, and the driver solves 4 x 4 systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.config import FEATURES
from ledgerlens.functions import columns as C
from ledgerlens.functions.ordered import add_running_sums
from ledgerlens.session import stage

TARGET = "TargetBuyNextMonth"
WIDTH = "WindowMonths"


def split_by_time(panel: DataFrame, train_end: date) -> tuple[DataFrame, DataFrame]:
    cut = C.day(train_end)
    return panel.where(F.col("BaseMonth") < cut), panel.where(F.col("BaseMonth") >= cut)


@dataclass
class LogisticModel:
    """Coefficients of the raw features, and how many passes over the rows the fit took."""

    coefficients: np.ndarray
    intercept: float
    passes: int


@dataclass
class WindowFit:
    window: int
    train_rows: int
    test_rows: int
    model: LogisticModel | None  # null when a side is empty or has one class only


@dataclass
class _Fit:
    """One width on its way: `beta` belongs to features scaled by `mean` and `std`, the intercept comes last."""

    mean: np.ndarray
    std: np.ndarray
    weights: tuple[float, float]
    beta: np.ndarray
    step: np.ndarray
    loss: float = float("inf")
    passes: int = 0
    done: bool = False


def fit_logistic_by(train: DataFrame, counts: dict, c: float = 1.0, max_iter: int = 100, tol: float = 1e-10) -> dict[int, LogisticModel]:
    """L2 logistic models on raw features with balanced class weights, one for each width in `counts`.

    `counts` holds the rows of either class by width. The intercept carries no penalty. A step that does not lower
    the loss is halved.
    """
    if not counts:
        return {}
    scale = train.where(F.col(WIDTH).isin(*counts)).groupBy(WIDTH).agg(
        *(F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(FEATURES)),
        *(F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(FEATURES)),
    )
    n = len(FEATURES)
    fits = {}
    for r in scale.collect():
        size = counts[r[WIDTH]]
        all_ = sum(size.values())
        std = np.array([r[f"s{i}"] or 1.0 for i in range(n)])
        weights = (all_ / (2.0 * size[0]), all_ / (2.0 * size[1]))
        fits[r[WIDTH]] = _Fit(np.array([r[f"m{i}"] for i in range(n)]), std, weights, np.zeros(n + 1), np.zeros(n + 1))
    for _ in range(max_iter):
        moving = {w: f for w, f in fits.items() if not f.done}
        if not moving:
            break
        for w, (loss, gradient, hessian) in _derivatives(train, moving).items():
            f = moving[w]
            f.passes += 1
            # The penalty is on raw coefficients, those of scaled features are `std` times as large.
            ridge = np.append(1.0 / (c * f.std**2), 0.0)
            loss += float(ridge @ f.beta**2) / 2
            # Below this a change is rounding alone.
            if loss > f.loss + 1e-9 * abs(f.loss):
                f.step /= 2
                f.beta = f.beta + f.step
                continue
            f.loss = loss
            f.step = np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * f.beta)
            f.beta = f.beta - f.step
            f.done = float(np.abs(f.step).max()) <= tol * max(1.0, float(np.abs(f.beta).max()))
    out = {}
    for w, f in fits.items():
        raw = f.beta[:n] / f.std
        out[w] = LogisticModel(raw, float(f.beta[n] - raw @ f.mean), f.passes)
    return out


def _derivatives(train: DataFrame, fits: dict[int, _Fit]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and second derivatives of every width at its `beta`, from one pass over the rows."""
    n = len(FEATURES)
    values = {f"_b{i}": [f.beta[i] for f in fits.values()] for i in range(n + 1)}
    values |= {f"_m{i}": [f.mean[i] for f in fits.values()] for i in range(n)}
    values |= {f"_s{i}": [f.std[i] for f in fits.values()] for i in range(n)}
    values |= {f"_w{y}": [f.weights[y] for f in fits.values()] for y in (0, 1)}
    table = train.sparkSession.createDataFrame(pa.table({WIDTH: pa.array(list(fits), pa.int32())} | {k: pa.array(v, pa.float64()) for k, v in values.items()}))
    # One row per width.
    rows = train.join(F.broadcast(table), WIDTH)
    z: list[Column] = [F.col(f"_z{i}") for i in range(n)] + [F.lit(1.0)]
    rows = rows.withColumns({f"_z{i}": (F.col(f).cast("double") - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, f in enumerate(FEATURES)})
    margin = sum((z[i] * F.col(f"_b{i}") for i in range(n)), F.col(f"_b{n}"))
    rows = rows.withColumn("_margin", margin).withColumn("_p", 1 / (1 + F.exp(-F.col("_margin"))))
    bought = F.col(TARGET) == 1
    rows = rows.withColumn("_w", F.when(bought, F.col("_w1")).otherwise(F.col("_w0")))
    signed = F.when(bought, -F.col("_margin")).otherwise(F.col("_margin"))
    loss = F.col("_w") * (F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs("_margin"))))
    off = F.col("_w") * (F.col("_p") - F.when(bought, 1.0).otherwise(0.0))
    bend = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
    pairs = [(i, j) for i in range(n + 1) for j in range(i + 1)]
    sums = rows.groupBy(WIDTH).agg(
        F.sum(loss).alias("loss"),
        *(F.sum(off * z[i]).alias(f"g{i}") for i in range(n + 1)),
        *(F.sum(bend * z[i] * z[j]).alias(f"h{i}{j}") for i, j in pairs),
    )
    out = {}
    for r in sums.collect():
        hessian = np.zeros((n + 1, n + 1))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = r[f"h{i}{j}"]
        out[r[WIDTH]] = (r["loss"], np.array([r[f"g{i}"] for i in range(n + 1)]), hessian)
    return out


def fit_logistic(train: DataFrame, counts: dict[int, int], c: float = 1.0) -> LogisticModel:
    """The model of one table, whatever the widths of its rows."""
    return fit_logistic_by(train.withColumn(WIDTH, F.lit(0)), {0: counts}, c)[0]


def chance(model: LogisticModel) -> Column:
    margin = sum((F.col(f).cast("double") * F.lit(float(b)) for f, b in zip(FEATURES, model.coefficients)), F.lit(model.intercept))
    return 1 / (1 + F.exp(-margin))


def fit_windows(panel: DataFrame, widths: Sequence[int], train_end: date) -> list[WindowFit]:
    """One model per window width. `panel` is read several times; stage it first."""
    late = (F.col("BaseMonth") >= C.day(train_end)).alias("_late")
    counts = {w: {False: {}, True: {}} for w in widths}
    for r in panel.groupBy(WIDTH, late, TARGET).count().collect():
        if r[WIDTH] in counts:
            counts[r[WIDTH]][r["_late"]][r[TARGET]] = r["count"]
    usable = {w: sides[False] for w, sides in counts.items() if len(sides[False]) == 2 and len(sides[True]) == 2}
    train, _ = split_by_time(panel, train_end)
    models = fit_logistic_by(train, usable)
    return [WindowFit(w, sum(counts[w][False].values()), sum(counts[w][True].values()), models.get(w)) for w in widths]


def score_windows(panel: DataFrame, fits: Sequence[WindowFit], train_end: date) -> DataFrame:
    """Test rows of every width; PredProb is null where no model could be fitted."""
    _, test = split_by_time(panel, train_end)
    found = F.lit(None).cast("double")
    for f in fits:
        if f.model is not None:
            found = F.when(F.col(WIDTH) == f.window, chance(f.model)).otherwise(found)
    return test.where(F.col(WIDTH).isin(*(f.window for f in fits))).withColumn("PredProb", found)


def auc(scored: DataFrame, by: Sequence[str], label: str = TARGET, prob: str = "PredProb") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null for one class.

    Rows collapse to one per score, then each positive needs the number of
    negatives scored below it: a running sum over a distributed sort.
    """
    per_score = (
        scored.where(F.col(prob).isNotNull())
        .groupBy(*by, prob)
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    )
    running = add_running_sums(per_score, {"_below": "_neg"}, [F.col(prob)], by)
    wins = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0)
    grouped = running.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    pairs = F.nullif(F.col("_p").cast("double") * F.col("_n"), F.lit(0.0))
    return grouped.select(
        *by,
        (F.col("_wins") / pairs).alias("AUC"),
        (F.col("_p") + F.col("_n")).alias("N"),
        (F.col("_p") / (F.col("_p") + F.col("_n"))).alias("PositiveRate"),
    )


@dataclass
class WindowReport:
    summary: DataFrame
    monthly: DataFrame
    scored: DataFrame


def evaluate_windows(panel: DataFrame, widths: Sequence[int], train_end: date) -> WindowReport:
    """AUC per width over all test rows, and per width and test month."""
    staged = stage(panel)
    fits = fit_windows(staged, widths, train_end)
    scored = stage(score_windows(staged, fits, train_end))
    # Every row counts for its month and for the whole test period.
    doubled = scored.withColumn("Period", F.explode(F.array(F.col("BaseMonthStr"), F.lit("all"))))
    table = stage(auc(doubled, ["WindowMonths", "Period"]))
    sizes = staged.sparkSession.createDataFrame(
        [(f.window, f.train_rows, f.test_rows) for f in fits], "WindowMonths int, TrainN long, TestN long"
    )
    overall = table.where(F.col("Period") == "all").select("WindowMonths", F.col("AUC").alias("OverallAUC"))
    summary = sizes.join(overall, "WindowMonths", "left").select("WindowMonths", "OverallAUC", "TrainN", "TestN")
    monthly = table.where(F.col("Period") != "all").select(
        F.col("Period").alias("BaseMonthStr"), "AUC", "N", "PositiveRate", "WindowMonths"
    )
    return WindowReport(summary.orderBy("WindowMonths"), monthly, scored)
