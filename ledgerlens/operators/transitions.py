"""Month-to-month grade transitions and grade summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.config import GRADE_NAMES, NO_ACTIVITY
from ledgerlens.functions import columns as C


def with_next_grade(panel: DataFrame, exclude_censored: bool = False) -> DataFrame:
    """Add NextGrade, grade numbers, MovementType and Moved.

    The following row of the customer counts only when it is exactly one month
    later, since a month may be missing from the panel. A customer has one row
    per panel month, so the window groups stay small. `exclude_censored` drops
    the last panel month, which has no next month for anybody.
    """
    ahead = Window.partitionBy("CustomerID").orderBy("AnalysisMonth")
    follows = F.lead("AnalysisMonth").over(ahead) == F.add_months("AnalysisMonth", 1)
    label = F.when(follows, F.lead("Customer_Grade").over(ahead))
    out = panel.withColumn("NextGrade", F.coalesce(label, F.lit(NO_ACTIVITY)))
    if exclude_censored:
        end = panel.agg(F.max("AnalysisMonth")).first()[0]
        out = out.where(F.col("AnalysisMonth") < F.lit(end))
    out = out.withColumns(
        {
            "CurrentGradeNum": C.grade_number(F.col("Customer_Grade")),
            "NextGradeNum": C.grade_number(F.col("NextGrade")),
        }
    )
    return out.withColumns(
        {
            "MovementType": C.movement(F.col("CurrentGradeNum"), F.col("NextGradeNum"), F.col("NextGrade")),
            "Moved": (F.col("Customer_Grade") != F.col("NextGrade")).cast("int"),
        }
    )


def mobility_summary(base: DataFrame) -> DataFrame:
    return (
        base.where(F.col("Customer_Grade").isNotNull())
        .groupBy("Customer_Grade")
        .agg(
            F.countDistinct("CustomerID").alias("Customers"),
            F.count(F.lit(1)).alias("Obs"),
            F.avg(F.col("Moved").cast("double")).alias("Move_Rate"),
        )
    )


def distribution(base: DataFrame, group: str, of: str = "MovementType") -> DataFrame:
    """Rows per (group, value) and their share inside the group."""
    share = F.col("Count") / F.sum("Count").over(Window.partitionBy(group))  # a few rows per group
    return (
        base.where(F.col(group).isNotNull())
        .groupBy(group, of)
        .agg(F.count(F.lit(1)).alias("Count"))
        .withColumn("Ratio", share)
    )


def transition_counts(base: DataFrame, grade: str) -> DataFrame:
    """Rows of one grade by next grade, long form."""
    return (
        base.where(F.col("Customer_Grade") == grade)
        .groupBy("Customer_Grade", "NextGrade")
        .agg(F.count(F.lit(1)).alias("Count"))
    )


def transition_ratios(base: DataFrame, grade: str) -> DataFrame:
    counts = transition_counts(base, grade)
    total = F.sum("Count").over(Window.partitionBy("Customer_Grade"))
    return counts.select("Customer_Grade", "NextGrade", (F.col("Count") / total).alias("Ratio"))


def transition_matrix(base: DataFrame, grade: str, names: Sequence[str] = GRADE_NAMES, ratio: bool = False) -> DataFrame:
    """Wide form of the counts or ratios, one column per known next grade."""
    long = transition_ratios(base, grade) if ratio else transition_counts(base, grade)
    value = "Ratio" if ratio else "Count"
    wide = long.groupBy("Customer_Grade").pivot("NextGrade", [*names, NO_ACTIVITY]).agg(F.sum(value))
    return wide.fillna(0)


def cluster_summary(graded: DataFrame, by: str = "Customer_Grade") -> DataFrame:
    return (
        graded.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.countDistinct("CustomerID").alias("Customers"),
            C.exact_mean(F.col("Recency")).alias("Mean_Recency"),
            C.exact_mean(F.col("Frequency")).alias("Mean_Frequency"),
            C.exact_mean(F.col("Monetary")).alias("Mean_Monetary"),
        )
    )


def cluster_means(graded: DataFrame) -> DataFrame:
    return graded.groupBy("Cluster").agg(
        *(C.exact_mean(F.col(c)).alias(c) for c in ("Recency", "Frequency", "Monetary"))
    )


def monthly_grade_counts(panel: DataFrame, names: Sequence[str] = GRADE_NAMES) -> DataFrame:
    """Customers per month and grade, one column per grade, 0 when there are none."""
    counts = panel.groupBy("AnalysisMonthStr", "Customer_Grade").agg(F.countDistinct("CustomerID").alias("_n"))
    wide = counts.groupBy("AnalysisMonthStr").pivot("Customer_Grade", list(names)).agg(F.sum("_n"))
    return wide.fillna(0)


def revenue_share_by_grade(panel: DataFrame) -> DataFrame:
    """Mean over months of each grade's share of the month's revenue, in percent.

    A grade without customers in a month does not count for that month; rows without a grade count in the
    month's revenue.
    """
    total = F.sum("_money").over(Window.partitionBy("AnalysisMonthStr"))  # one row per grade and month
    monthly = (
        panel.groupBy("AnalysisMonthStr", "Customer_Grade")
        .agg(F.sum(F.col("Monetary").cast(C.MONEY)).alias("_money"))
        .withColumn("_share", F.col("_money").cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))
        .where(F.col("Customer_Grade").isNotNull())
    )
    return monthly.groupBy("Customer_Grade").agg(F.bround(F.avg("_share") * 100, 2).alias("Avg_Revenue_Share"))


def cluster_profile(summary: DataFrame, shares: DataFrame) -> DataFrame:
    return summary.join(shares, "Customer_Grade", "left")
