"""Quintile scores, rule segments, revenue tiers and VIP figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.ordered import add_rank, quantile_values

_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def quintile_edges(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Six edges per column. Repeated edges have no quintiles and raise."""
    values = quantile_values(df, columns, _EDGES)
    edges = {c: [values.get((c, p)) for p in _EDGES] for c in columns}
    for column, row in edges.items():
        if None in row or len(set(row)) < len(row):
            raise ValueError(f"quintile edges of {column} are not distinct: {row}")
    return edges


def quintile(value: Column, edges: Sequence[float], reverse: bool = False) -> Column:
    """1..5 by right-closed bins; the smallest value belongs to the first bin."""
    labels = (5, 4, 3, 2, 1) if reverse else (1, 2, 3, 4, 5)
    score = F.when(value <= edges[1], labels[0])
    for edge, label in zip(edges[2:5], labels[1:4]):
        score = score.when(value <= edge, label)
    return F.when(value.isNotNull(), score.otherwise(labels[4]))


def add_scores(rfm: DataFrame) -> DataFrame:
    """R, F and M scores, the combined text and the rule segment.

    Frequency is scored on its rank, ties taken in customer order.
    """
    edges = quintile_edges(rfm, ["Recency", "Monetary"])
    steps = rfm.count() - 1
    ranked = add_rank(rfm, [F.col("Frequency"), F.col("CustomerID")], name="_rank")
    # Smallest s with rank - 1 <= steps * s / 5, in whole numbers.
    f_score = F.greatest(F.lit(1), F.floor(((F.col("_rank") - 1) * 5 + (steps - 1)) / F.lit(steps))).cast("int")
    scored = ranked.withColumns(
        {
            "R_score": quintile(F.col("Recency"), edges["Recency"], reverse=True),
            "F_score": f_score,
            "M_score": quintile(F.col("Monetary"), edges["Monetary"]),
        }
    ).drop("_rank")
    return scored.withColumns(
        {
            "RFM_score": F.concat(*(F.col(f"{v}_score").cast("string") for v in "RFM")),
            "Segment2": rule_segment(F.col("R_score"), F.col("F_score"), F.col("M_score")),
        }
    )


def rule_segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "VIP")
        .when((r <= 2) & (f <= 2), "At-risk")
        .when(f >= 4, "Loyal")
        .otherwise("General")
    )


def add_revenue_tier(rfm: DataFrame) -> DataFrame:
    cuts = quantile_values(rfm, ["Monetary"], [0.5, 0.75])
    middle, top = (F.lit(cuts.get(("Monetary", p))).cast("double") for p in (0.5, 0.75))
    money = F.col("Monetary")
    return rfm.withColumn("Segment", F.when(money >= top, "VIP").when(money >= middle, "Mid").otherwise("Low"))


def add_log_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_Frequency": F.log1p("Frequency"), "log_Monetary": F.log1p("Monetary")})


def vip_threshold(rfm: DataFrame) -> float | None:
    return quantile_values(rfm, ["Monetary"], [0.75]).get(("Monetary", 0.75))


def vip_summary(rfm: DataFrame, threshold: float | None) -> DataFrame:
    """VIP customers, their share of customers and of revenue.

    A customer's Monetary is the sum of its lines, so revenue needs no second
    look at the lines.
    """
    top = F.col("Monetary") >= F.lit(threshold).cast("double")
    money = F.col("Monetary").cast(C.MONEY)
    return rfm.agg(
        F.count_if(top).alias("VIP_Customers"),
        C.rate(top).alias("VIP_Customer_Ratio"),
        (
            F.coalesce(F.sum(F.when(top, money)).cast("double"), F.lit(0.0))
            / F.nullif(F.sum(money).cast("double"), F.lit(0.0))
        ).alias("VIP_Revenue_Ratio"),
    )


def vip_class_a_share(pairs: DataFrame, threshold: float | None) -> DataFrame:
    """Share of class A products in the revenue of VIP customers."""
    money = F.col("Revenue").cast(C.MONEY)
    return (
        pairs.where(F.col("Monetary") >= F.lit(threshold).cast("double"))
        .agg(
            F.coalesce(F.sum(money).cast("double"), F.lit(0.0)).alias("VIP_Total"),
            F.coalesce(F.sum(F.when(F.col("ABC_Class") == "A", money)).cast("double"), F.lit(0.0)).alias("VIP_A"),
        )
        .withColumn("VIP_A_Ratio", F.col("VIP_A") / F.nullif(F.col("VIP_Total"), F.lit(0.0)))
    )


def with_segment(pairs: DataFrame, customers: DataFrame) -> DataFrame:
    """Replace Segment on customer x product rows."""
    return pairs.drop("Segment").join(customers.select("CustomerID", "Segment"), "CustomerID", "left")


def segment_abc_mix(pairs: DataFrame) -> DataFrame:
    """Revenue per segment and class, with the share of the whole segment (rows without a class count there)."""
    total = F.sum("Revenue").over(Window.partitionBy("Segment"))  # at most twelve rows
    return (
        pairs.where(F.col("Segment").isNotNull())
        .groupBy("Segment", "ABC_Class")
        .agg(C.exact_sum(F.col("Revenue")).alias("Revenue"))
        .withColumn("TotalRevenue", total)
        .where(F.col("ABC_Class").isNotNull())
        .withColumn("Ratio", F.col("Revenue") / F.nullif(F.col("TotalRevenue"), F.lit(0.0)))
    )
