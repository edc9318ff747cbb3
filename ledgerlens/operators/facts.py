"""Monthly pre-aggregates of clean lines.

Every rolling window is aligned to months, so the window operators read these
tables and never the lines. A customer has at most one row per month in
`customer_months`, however many lines it owns.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions import columns as C


def _within(period: tuple[date, date] | None, value: Column) -> Column:
    if period is None:
        return value
    return F.when((F.col("InvoiceDate") >= C.instant(period[0])) & (F.col("InvoiceDate") < C.instant(period[1])), value)


def order_months(clean: DataFrame, period: tuple[date, date] | None = None) -> DataFrame:
    """One row per (customer, invoice, month).

    The `Period...` columns cover only lines in `period` (from, before), which may begin and end inside a month.
    """
    first, money = F.col("InvoiceDate"), F.col("Revenue").cast(C.MONEY)
    return (
        clean.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID", "InvoiceNo", "MonthStart")
        .agg(
            F.min("InvoiceDate").alias("FirstDate"),
            F.max("InvoiceDate").alias("LastDate"),
            F.sum(money).alias("Money"),
            F.min(_within(period, first)).alias("PeriodFirst"),
            F.max(_within(period, first)).alias("PeriodLast"),
            F.sum(_within(period, money)).alias("PeriodMoney"),
        )
    )


def in_period(orders: DataFrame) -> DataFrame:
    """`order_months` rows reduced to their lines in the period."""
    return orders.where(F.col("PeriodFirst").isNotNull()).select(
        "CustomerID",
        "InvoiceNo",
        "MonthStart",
        F.col("PeriodFirst").alias("FirstDate"),
        F.col("PeriodLast").alias("LastDate"),
        F.col("PeriodMoney").alias("Money"),
    )


def customer_months(orders: DataFrame, widest: int) -> DataFrame:
    """One row per (customer, month) that can answer any window up to `widest` months.

    `OrdersAt[d-1]` is the number of this month's invoices that do not show up
    again within the next d-1 months. A window ending d months after this one
    adds exactly those, so an invoice with lines in several months is counted
    once and distinct counts turn into sums.
    """
    ahead = Window.partitionBy("CustomerID", "InvoiceNo").orderBy("MonthStart")
    gap = F.months_between(F.lead("MonthStart").over(ahead), "MonthStart").cast("int")
    rows = orders.withColumn("_gap", F.coalesce(gap, F.lit(widest)))
    at = F.array(*(F.count_if(F.col("_gap") >= d) for d in range(1, widest + 1)))
    return rows.groupBy("CustomerID", "MonthStart").agg(
        F.min("FirstDate").alias("FirstDate"),
        F.max("LastDate").alias("LastDate"),
        F.sum("Money").alias("Money"),
        at.alias("OrdersAt"),
    )


def product_months(clean: DataFrame, period: tuple[date, date] | None = None) -> DataFrame:
    """One row per (customer, stock code, month); `Period...` columns as in `order_months`."""
    units, money = F.col("Quantity").cast(C.MONEY), F.col("Revenue").cast(C.MONEY)
    return (
        clean.where(F.col("CustomerID").isNotNull() & F.col("StockCode").isNotNull())
        .groupBy("CustomerID", "StockCode", "MonthStart")
        .agg(
            F.sum(units).alias("Units"),
            F.sum(money).alias("Money"),
            F.count(_within(period, F.lit(1))).alias("PeriodLines"),
            F.sum(_within(period, units)).alias("PeriodUnits"),
            F.sum(_within(period, money)).alias("PeriodMoney"),
        )
    )
