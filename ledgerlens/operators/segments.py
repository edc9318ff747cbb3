"""Order-level and grade-level revenue reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.config import GRADE_NAMES
from ledgerlens.functions import columns as C
from ledgerlens.operators.products import CLASSES


def order_summary(lines: DataFrame, graded: DataFrame, how: str = "left") -> DataFrame:
    """Revenue and latest month per order, with the customer's grade.

    'inner' leaves out customers without a grade; that saves filtering the
    lines of all customers to the graded ones beforehand.
    """
    orders = (
        lines.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID", "InvoiceNo")
        .agg(C.exact_sum(F.col("Revenue")).alias("OrderRevenue"), F.max("YearMonth").alias("YearMonth"))
    )
    return orders.join(graded.select("CustomerID", "Customer_Grade"), "CustomerID", how)


def order_summary_of_months(orders: DataFrame, graded: DataFrame, how: str = "left") -> DataFrame:
    """`order_summary` from `order_months` rows, so that lines need not be read again."""
    whole = orders.groupBy("CustomerID", "InvoiceNo").agg(
        F.sum("Money").cast("double").alias("OrderRevenue"), C.month_text(F.max("MonthStart")).alias("YearMonth")
    )
    return whole.join(graded.select("CustomerID", "Customer_Grade"), "CustomerID", how)


def segment_summary(orders: DataFrame) -> DataFrame:
    per_grade = (
        orders.where(F.col("Customer_Grade").isNotNull())
        .groupBy("Customer_Grade")
        .agg(
            F.countDistinct("CustomerID").alias("Customers"),
            F.countDistinct("InvoiceNo").alias("Orders"),
            C.exact_sum(F.col("OrderRevenue")).alias("Revenue"),
        )
    )
    whole = Window.partitionBy()  # one row per grade
    return per_grade.select(
        "*",
        (F.col("Revenue") / F.col("Orders")).alias("AOV"),
        (F.col("Revenue") / F.col("Customers")).alias("Revenue_per_Customer"),
        (F.col("Customers") / F.sum("Customers").over(whole)).alias("Customer_Share"),
        (F.col("Revenue") / F.nullif(F.sum("Revenue").over(whole), F.lit(0.0))).alias("Revenue_Share"),
        C.grade_order(F.col("Customer_Grade")).alias("GradeOrder"),
    ).orderBy("GradeOrder")


def grade_abc_matrix(pairs: DataFrame) -> DataFrame:
    """Share of A, B and C in each grade's revenue."""
    revenue = (
        pairs.where(F.col("Customer_Grade").isNotNull() & F.col("ABC_Class").isNotNull())
        .groupBy("Customer_Grade")
        .pivot("ABC_Class", list(CLASSES))
        .agg(F.sum(F.col("Revenue").cast(C.MONEY)).cast("double"))
        .fillna(0.0)
    )
    total = F.nullif(sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])), F.lit(0.0))
    return revenue.select("Customer_Grade", *((F.col(c) / total).alias(c) for c in CLASSES)).orderBy(
        C.grade_order(F.col("Customer_Grade"))
    )


def grade_month_revenue(orders: DataFrame, graded: DataFrame, names: Sequence[str] = GRADE_NAMES) -> DataFrame:
    """Revenue per month and grade of `order_months` rows, one column per grade.

    Orders collapse to customer-months before they meet the grades, so a busy customer brings a handful of rows to
    the join.
    """
    monthly = orders.groupBy("CustomerID", C.month_text(F.col("MonthStart")).alias("YearMonth")).agg(F.sum("Money").alias("_money"))
    return (
        monthly.join(graded.select("CustomerID", "Customer_Grade"), "CustomerID")
        .where(F.col("Customer_Grade").isNotNull())
        .groupBy("YearMonth")
        .pivot("Customer_Grade", list(names))
        .agg(F.sum("_money").cast("double"))
        .fillna(0.0)
        .orderBy("YearMonth")
    )
