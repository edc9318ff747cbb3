"""Recency / frequency / monetary tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.hot_keys import join_hot
from ledgerlens.functions.ordered import quantile_values

COLUMNS = ("CustomerID", "FirstPurchaseDate", "LastPurchaseDate", "Recency", "Frequency", "Monetary")


def snapshot_of(
    rows: DataFrame, snapshot: date | datetime | str, column: str = "InvoiceDate"
) -> datetime | date | None:
    """A given date, or 'max' / 'max+1d' of the rows (null for no rows)."""
    if not isinstance(snapshot, str):
        return snapshot
    if snapshot not in ("max", "max+1d"):
        raise ValueError("snapshot must be a date, 'max' or 'max+1d'")
    last = rows.agg(F.max(column)).first()[0]
    return last + timedelta(days=1) if last is not None and snapshot == "max+1d" else last


def create_rfm(lines: DataFrame, snapshot: date | datetime | str = "max+1d") -> DataFrame:
    """One row per customer. No lines give no rows.

    Lines first collapse to one row per (customer, invoice): the distinct
    invoice count becomes a plain count, and a customer who owns a third of
    all lines is spread over its invoices in the wide shuffle.
    """
    at = snapshot_of(lines, snapshot)
    invoices = (
        lines.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID", "InvoiceNo")
        .agg(
            F.min("InvoiceDate").alias("FirstDate"),
            F.max("InvoiceDate").alias("LastDate"),
            F.sum(F.col("Revenue").cast(C.MONEY)).alias("Money"),
        )
    )
    return _of_invoices(invoices, at)


def rfm_of_orders(orders: DataFrame, snapshot: date | datetime | str) -> DataFrame:
    """The same from `order_months` rows, where an invoice may span several months."""
    at = snapshot_of(orders, snapshot, "LastDate")
    invoices = orders.groupBy("CustomerID", "InvoiceNo").agg(
        F.min("FirstDate").alias("FirstDate"), F.max("LastDate").alias("LastDate"), F.sum("Money").alias("Money")
    )
    return _of_invoices(invoices, at)


def _of_invoices(invoices: DataFrame, at: date | datetime | None) -> DataFrame:
    when = C.instant(at) if at is not None else F.lit(None).cast("timestamp_ntz")
    return (
        invoices.groupBy("CustomerID")
        .agg(
            F.min("FirstDate").alias("FirstPurchaseDate"),
            F.max("LastDate").alias("LastPurchaseDate"),
            F.count("InvoiceNo").alias("Frequency"),
            F.coalesce(F.sum("Money").cast("double"), F.lit(0.0)).alias("Monetary"),
        )
        .withColumn("Recency", C.recency_months(F.col("LastPurchaseDate"), when))
        .select(*COLUMNS)
    )


def with_idle(rfm: DataFrame, customers: DataFrame, window_months: int) -> DataFrame:
    """Rfm for every given customer; one without lines gets 0, 0 and window + 1."""
    return (
        customers.select("CustomerID")
        .distinct()
        .join(rfm, "CustomerID", "left")
        .select(
            "CustomerID",
            "FirstPurchaseDate",
            "LastPurchaseDate",
            F.coalesce("Recency", F.lit(float(window_months + 1))).alias("Recency"),
            F.coalesce("Frequency", F.lit(0)).alias("Frequency"),
            F.coalesce("Monetary", F.lit(0.0)).alias("Monetary"),
        )
    )


def outlier_cutoffs(rfm: DataFrame, quantile: float = 0.99) -> tuple[float | None, float | None]:
    values = quantile_values(rfm, ["Frequency", "Monetary"], [quantile])
    return values.get(("Frequency", quantile)), values.get(("Monetary", quantile))


def drop_outliers(rfm: DataFrame, cutoffs: tuple[float | None, float | None]) -> DataFrame:
    frequency, monetary = (F.lit(c).cast("double") for c in cutoffs)
    return rfm.where((F.col("Frequency") <= frequency) & (F.col("Monetary") <= monetary))


def outlier_summary(rfm: DataFrame, cutoffs: tuple[float | None, float | None]) -> DataFrame:
    frequency, monetary = (F.lit(c).cast("double") for c in cutoffs)
    kept = F.count_if((F.col("Frequency") <= frequency) & (F.col("Monetary") <= monetary))
    return rfm.agg(F.count(F.lit(1)).alias("OriginalCustomers"), kept.alias("FilteredCustomers")).select(
        "OriginalCustomers",
        "FilteredCustomers",
        (F.col("OriginalCustomers") - F.col("FilteredCustomers")).alias("RemovedCustomers"),
        frequency.alias("Frequency99Cutoff"),
        monetary.alias("Monetary99Cutoff"),
    )


def of_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows whose customer is in `customers`."""
    return df.join(customers.select("CustomerID"), "CustomerID", "left_semi")


def lines_of_customers(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """The same for lines: a customer with very many of them keeps them spread over the tasks."""
    return join_hot(lines, customers.select("CustomerID").distinct(), ["CustomerID"], "left_semi")
