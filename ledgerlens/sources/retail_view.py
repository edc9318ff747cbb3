"""Raw retail transactions derived from star-schema order tables.

Fixed arithmetic adds cancellations, charges, zero prices, missing customers
and foreign orders, so that each cleaning rule has lines to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.config import NON_PRODUCT_CODES, RetailConfig

# The tables' dates lie eleven years before the default run.
VIEW_CONFIG = RetailConfig().shifted(-11)


# Given schemas, reduced to what the view needs: no job to infer them.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double",
}


def retail_lines(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    country = F.when(F.col("c_nationkey") < 20, "United Kingdom").otherwise(F.col("n_name"))
    buyers = (
        table("customer")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", country.alias("Country"))
    )
    key = F.col("o_orderkey")
    cancelled = key % 50 == 0
    # Order-level columns are built before the join with the much longer lines.
    orders = (
        table("orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            F.concat(F.when(cancelled, "C").otherwise(""), key.cast("string")).alias("Invoice"),
            (
                F.col("o_orderdate").cast("timestamp_ntz")
                + F.make_dt_interval(F.lit(0), F.lit(0), (key % 1440).cast("int"), F.lit(0))
            ).alias("InvoiceDate"),
            F.when(key % 10 != 3, F.col("o_custkey").cast("double")).alias("Customer ID"),
            "Country",
        )
    )
    part, qty = F.col("l_partkey"), F.col("l_quantity")
    code = F.element_at(
        F.array(*(F.lit(c) for c in NON_PRODUCT_CODES)),
        (1 + F.floor(part / 100) % len(NON_PRODUCT_CODES)).cast("int"),
    )
    return (
        table("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "Invoice",
            F.when(part % 100 == 0, code).otherwise(part.cast("string")).alias("StockCode"),
            F.when(cancelled, -qty).otherwise(qty).alias("Quantity"),
            "InvoiceDate",
            F.when((F.col("l_linenumber") == 7) & (part % 5 == 0), F.lit(0.0))
            .otherwise(F.col("l_extendedprice") / qty)
            .alias("Price"),
            "Customer ID",
            "Country",
        )
    )
