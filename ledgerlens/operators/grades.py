"""Customer grades from K-means clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerlens.config import FEATURES, RetailConfig
from ledgerlens.operators import kmeans, silhouette
from ledgerlens.operators.kmeans import ClusterModel

_ALL = "_whole"  # constant group column of a table that is fitted as one group


def _one_group(df: DataFrame) -> DataFrame:
    return df.withColumn(_ALL, F.lit(0))


def _fit_options(config: RetailConfig) -> dict:
    return dict(n_init=config.n_init, seed=config.seed, max_iter=config.max_iter, tol=config.tol)


def fit_whole(rfm: DataFrame, config: RetailConfig) -> ClusterModel | None:
    """Model of one table, null when it has fewer rows than clusters."""
    models = kmeans.fit(_one_group(rfm), _ALL, [config.final_k], **_fit_options(config))
    return models[0] if models else None


def fit_months(panel: DataFrame, config: RetailConfig) -> list[ClusterModel]:
    """One model per AnalysisMonth, each with its own scaling. Months with too few rows have none."""
    return kmeans.fit(panel, "AnalysisMonth", [config.final_k], **_fit_options(config))


def evaluate_k(rfm: DataFrame, config: RetailConfig, distance: str = "squared") -> DataFrame:
    """Inertia and silhouette for each k that has more rows than clusters.

    `distance` is 'squared' (two linear passes), 'euclidean' (from cells, with the column Bound) or
    'euclidean_exact' (distances of all points, to rounding), at any size.
    """
    methods = {"squared": silhouette.squared, "euclidean": silhouette.euclidean, "euclidean_exact": silhouette.euclidean_exact}
    if distance not in methods:
        raise ValueError(f"distance must be one of {', '.join(methods)}")
    models = kmeans.fit(_one_group(rfm), _ALL, config.k_values, spare_rows=1, **_fit_options(config))
    spark = rfm.sparkSession
    if not models:
        bound = ", Bound double" if distance == "euclidean" else ""
        return spark.createDataFrame([], f"k int, Inertia double, Silhouette double{bound}, Distance string")
    labelled = kmeans.assign(_one_group(rfm), _ALL, models)
    axes = [f"_x{i}" for i in range(len(FEATURES))]
    scores = methods[distance](labelled.select("K", *axes, "Cluster"), axes)
    inertia = spark.createDataFrame([(m.k, m.cost) for m in models], "K int, Inertia double")
    return inertia.join(scores, "K", "left").select(
        F.col("K").alias("k"), "Inertia", *scores.columns[1:], F.lit(distance).alias("Distance")
    )


def grade_of_cluster(model: ClusterModel, names: Sequence[str]) -> list[str]:
    """Grade name by cluster number: poorest, rarest and longest-idle center first."""
    if model.k > len(names):
        raise ValueError(f"{model.k} clusters need as many grade names, not {len(names)}")
    raw = model.raw_centers()
    ranking = sorted(range(model.k), key=lambda j: (raw[j][2], raw[j][1], -raw[j][0]))
    grades = [""] * model.k
    for position, cluster in enumerate(ranking):
        grades[cluster] = names[position]
    return grades


def apply_grades(
    df: DataFrame, models: Sequence[ClusterModel], names: Sequence[str], group: str | None = None
) -> DataFrame:
    """Add Cluster and Customer_Grade. Without `group` one model serves all rows."""
    if not models:
        return df.where(F.lit(False)).withColumns(
            {"Cluster": F.lit(None).cast("int"), "Customer_Grade": F.lit(None).cast("string")}
        )
    labelled = kmeans.assign(df, group, models)
    cells = [(m.group, cluster, g) for m in models for cluster, g in enumerate(grade_of_cluster(m, names))]
    if group is None:
        options = F.array(*(F.lit(g) for _, _, g in cells))
        graded = labelled.withColumn("Customer_Grade", F.get(options, F.col("Cluster")))
    else:
        # groups x k rows
        table = kmeans.small_table(
            df,
            {
                group: [c[0] for c in cells],
                "Cluster": np.array([c[1] for c in cells], dtype=np.int32),
                "Customer_Grade": [c[2] for c in cells],
            },
        )
        graded = labelled.join(F.broadcast(table), [group, "Cluster"], "left")

    return graded.select(*df.columns, "Cluster", "Customer_Grade")


def centers_table(spark, models: Sequence[ClusterModel], names: Sequence[str]) -> DataFrame:
    """Centers in raw units with their grade, k rows per model."""
    rows = []
    for m in models:
        raw = m.raw_centers()
        for cluster, g in enumerate(grade_of_cluster(m, names)):
            rows.append((m.group, cluster, *(float(v) for v in raw[cluster]), g))
    kind = "date" if rows and hasattr(rows[0][0], "month") else "int"
    return spark.createDataFrame(
        rows, f"Grouping {kind}, Cluster int, Recency double, Frequency double, Monetary double, Customer_Grade string"
    )
