"""Product revenue, ABC classes and the customer x product table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.ordered import add_rank, add_running_sums

CLASSES = ("A", "B", "C")


def product_sales(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("StockCode").isNotNull())
        .groupBy("StockCode")
        .agg(C.exact_sum(F.col("Quantity")).alias("Quantity"), C.exact_sum(F.col("Revenue")).alias("Revenue"))
    )


def add_abc(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running revenue from the best seller down, its share of the total, and the class.

    Products with equal revenue are taken in stock-code order.
    """
    exact = sales.withColumn("_money", F.col("Revenue").cast(C.MONEY))
    running = add_running_sums(
        exact, {"_run": "_money"}, [F.col("Revenue").desc(), F.col("StockCode")], by, {"_total": "_money"}
    )
    return (
        running.withColumn("CumulativeRevenue", F.col("_run").cast("double"))
        .withColumn("CumulativeRatio", F.col("CumulativeRevenue") / F.nullif(F.col("_total").cast("double"), F.lit(0.0)))
        .withColumn("ABC_Class", C.abc_class(F.col("CumulativeRatio")))
        .drop("_money", "_run", "_total")
    )


def analyze_products(lines: DataFrame) -> DataFrame:
    return add_abc(product_sales(lines))


def long_tail(sales: DataFrame) -> DataFrame:
    """0-based revenue rank of each product."""
    ranked = add_rank(sales.select("StockCode", "Revenue"), [F.col("Revenue").desc(), F.col("StockCode")], name="_rank")
    return ranked.select("StockCode", "Revenue", (F.col("_rank") - 1).alias("ProductRank"))


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    return sales.orderBy(F.col("Revenue").desc(), "StockCode").limit(n)


def abc_revenue_share(products: DataFrame) -> DataFrame:
    """Revenue share of A, B and C, in that order; a class without products is null."""
    one_row = products.agg(
        F.sum(F.col("Revenue").cast(C.MONEY)).alias("_all"),
        *(F.sum(F.when(F.col("ABC_Class") == c, F.col("Revenue").cast(C.MONEY))).alias(c) for c in CLASSES),
    )
    cells = [
        F.struct(
            F.lit(i).alias("Position"),
            F.lit(c).alias("ABC_Class"),
            (F.col(c).cast("double") / F.nullif(F.col("_all").cast("double"), F.lit(0.0))).alias("Share"),
        )
        for i, c in enumerate(CLASSES)
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def customer_product(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("CustomerID").isNotNull() & F.col("StockCode").isNotNull())
        .groupBy("CustomerID", "StockCode")
        .agg(C.exact_sum(F.col("Quantity")).alias("Quantity"), C.exact_sum(F.col("Revenue")).alias("Revenue"))
    )


def integrate(pairs: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Customer x product rows with customer figures and product class."""
    extra = [c for c in ("Recency", "Frequency", "Monetary", "Customer_Grade") if c in customers.columns]
    return pairs.join(customers.select("CustomerID", *extra), "CustomerID", "left").join(
        products.select("StockCode", "ABC_Class"), "StockCode", "left"
    )


def rolling_abc(product_months: DataFrame, first: date, last: date, window: int) -> DataFrame:
    """ABC class of each product in the `window` months before every month of [first, last]."""
    monthly = product_months.groupBy("StockCode", "MonthStart").agg(F.sum("Money").alias("Money"))
    spread = monthly.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn(
        "AnalysisMonth", F.add_months("MonthStart", F.col("_d"))
    )
    sales = (
        spread.where(F.col("AnalysisMonth").between(C.day(first), C.day(last)))
        .groupBy("AnalysisMonth", "StockCode")
        .agg(F.sum("Money").cast("double").alias("Revenue"))
    )
    return add_abc(sales, ["AnalysisMonth"])
