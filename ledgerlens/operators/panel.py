"""Rolling monthly panels built from `customer_months`."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import columns as C


def month_range(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Month starts from `first` to `last`, both included."""
    months = F.sequence(C.day(first), C.day(last), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("AnalysisMonth"))


def window_rows(months: DataFrame, first: date, last: date, widths: Sequence[int]) -> DataFrame:
    """Each customer-month placed in every window that contains it.

    A month lies in the windows ending 1..w months later. Spreading the
    pre-aggregated months replaces an interval join of lines with windows.
    """
    spread = months.withColumn("WindowMonths", F.explode(F.array(*(F.lit(w) for w in widths))))
    spread = spread.withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("WindowMonths"))))
    return spread.select(
        "CustomerID",
        "WindowMonths",
        F.add_months("MonthStart", F.col("_d")).alias("AnalysisMonth"),
        "FirstDate",
        "LastDate",
        "Money",
        F.element_at("OrdersAt", F.col("_d")).alias("Orders"),
    ).where(F.col("AnalysisMonth").between(C.day(first), C.day(last)))


def _rfm_columns(grouped) -> DataFrame:
    return grouped.agg(
        F.min("FirstDate").alias("FirstPurchaseDate"),
        F.max("LastDate").alias("LastPurchaseDate"),
        F.coalesce(F.sum("Orders"), F.lit(0)).alias("Frequency"),
        F.coalesce(F.sum("Money").cast("double"), F.lit(0.0)).alias("Monetary"),
    ).withColumn(
        "Recency", C.recency_months(F.col("LastPurchaseDate"), F.col("AnalysisMonth").cast("timestamp_ntz"))
    )


def rolling_rfm(months: DataFrame, customers: DataFrame, first: date, last: date, window: int) -> DataFrame:
    """Rfm of the `window` months before every month, for all given customers.

    Idle customers enter as empty rows of the same aggregation, so the panel
    costs one shuffle and no join.
    """
    active = window_rows(months, first, last, [window]).drop("WindowMonths")
    every = F.sequence(C.day(first), C.day(last), F.expr("interval 1 month"))
    idle = customers.select(
        "CustomerID",
        F.explode(every).alias("AnalysisMonth"),
        *(F.lit(None).cast(active.schema[c].dataType).alias(c) for c in ("FirstDate", "LastDate", "Money", "Orders")),
    )
    table = _rfm_columns(active.unionByName(idle).groupBy("CustomerID", "AnalysisMonth"))
    return table.select(
        "CustomerID",
        "FirstPurchaseDate",
        "LastPurchaseDate",
        F.coalesce("Recency", F.lit(float(window + 1))).alias("Recency"),
        "Frequency",
        "Monetary",
        "AnalysisMonth",
        C.month_text(F.col("AnalysisMonth")).alias("AnalysisMonthStr"),
        F.add_months("AnalysisMonth", -window).alias("WindowStart"),
        F.col("AnalysisMonth").alias("WindowEnd"),
    )


def snapshot_panel(
    months: DataFrame, first: date, last: date, widths: Sequence[int], gap_months: int = 1
) -> DataFrame:
    """Rfm of customers active in each window, with the purchase target.

    The target month starts `gap_months` after the snapshot month, so with the
    default of 1 the month that follows the features directly is skipped. All
    widths share one pass.
    """
    rfm = _rfm_columns(
        window_rows(months, first, last, widths).groupBy("CustomerID", "WindowMonths", "AnalysisMonth")
    )
    # One row per customer and month already: a key can match only once.
    buyers = months.select(
        "CustomerID",
        F.add_months("MonthStart", -gap_months).alias("AnalysisMonth"),
        F.lit(1).alias("_bought"),
    )
    return rfm.join(buyers, ["CustomerID", "AnalysisMonth"], "left").select(
        "CustomerID",
        F.col("AnalysisMonth").alias("BaseMonth"),
        C.month_text(F.col("AnalysisMonth")).alias("BaseMonthStr"),
        "WindowMonths",
        "Recency",
        "Frequency",
        "Monetary",
        F.coalesce("_bought", F.lit(0)).alias("TargetBuyNextMonth"),
    )
