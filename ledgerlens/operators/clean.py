"""Cleaning rules over raw lines, and the per-rule audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.config import RetailConfig
from ledgerlens.functions import columns as C
from ledgerlens.session import stage

# Accepted raw names and the names used from here on.
ALIASES = {"Invoice": "InvoiceNo", "Price": "UnitPrice", "Customer ID": "CustomerID"}

# Columns that must be present after renaming.
REQUIRED = ("InvoiceNo", "StockCode", "Country", "UnitPrice", "CustomerID", "InvoiceDate", "Quantity")

# Names of the audit rows, in order.
STEPS = (
    "00_raw_loaded",
    "01_drop_missing_customer_date_stockcode",
    "02_remove_cancel_orders",
    "03_remove_non_positive_quantity_price",
    "04_remove_non_product_codes",
    "05_filter_country_uk",
    "06_filter_analysis_period",
)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(ALIASES)


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; found {df.columns}")
    return df


def typed(df: DataFrame, date_formats: Sequence[str] = (), strict_nulls: bool = False) -> DataFrame:
    """Lenient casts, text casts, default Description and Revenue.

    CustomerID becomes id text and is null when missing. Text columns turn a
    missing value into 'nan' unless `strict_nulls` is set.
    """
    text = (lambda c: F.col(c).cast("string")) if strict_nulls else C.as_text
    has_note = "Description" in df.columns
    out = df.withColumns(
        {
            "InvoiceDate": C.as_instant("InvoiceDate", date_formats),
            "Quantity": C.as_number("Quantity"),
            "UnitPrice": C.as_number("UnitPrice"),
            "InvoiceNo": text("InvoiceNo"),
            "StockCode": text("StockCode"),
            "Country": text("Country"),
            "Description": text("Description") if has_note else F.lit(""),
            "CustomerID": C.as_id("CustomerID", df.schema["CustomerID"].dataType.typeName() in ("float", "double")),
        }
    )
    return out.withColumn("Revenue", F.col("Quantity") * F.col("UnitPrice"))


def normalise(raw: DataFrame, config: RetailConfig) -> DataFrame:
    named = require_columns(rename_columns(trim_names(raw)))
    return typed(named, config.date_formats, config.strict_nulls)


def rules(config: RetailConfig) -> list[Column]:
    """Keep-conditions of steps 1..6, in order. None of them is ever null."""
    c = F.col
    present = c("CustomerID").isNotNull() & c("InvoiceDate").isNotNull() & c("StockCode").isNotNull()
    return [
        present,
        ~is_cancelled(c("InvoiceNo")),
        F.coalesce((c("Quantity") > 0) & (c("UnitPrice") > 0), F.lit(False)),
        ~c("StockCode").isin(*config.non_product_codes),
        F.coalesce(c("Country") == config.country, F.lit(False)),
        in_period(c("InvoiceDate"), config.start, config.end),
    ]


def is_cancelled(invoice: Column) -> Column:
    return F.coalesce(F.upper(invoice).startswith("C"), F.lit(False))


def in_period(when: Column, start, end) -> Column:
    return (when >= C.instant(start)) & (when < C.instant(end))


def between(df: DataFrame, start, end) -> DataFrame:
    """Lines of the half-open period [start, end)."""
    return df.where(in_period(F.col("InvoiceDate"), start, end))


def add_date_parts(df: DataFrame) -> DataFrame:
    d = F.col("InvoiceDate")
    return df.withColumns(
        {
            "Year": F.year(d),
            "Month": F.month(d),
            "YearMonth": C.month_text(d),
            "MonthStart": C.month_of(d),
        }
    )


def clean(raw: DataFrame, config: RetailConfig) -> DataFrame:
    """Lines that pass every rule, with date parts. One scan, no shuffle."""
    kept = normalise(raw, config)
    for rule in rules(config):
        kept = kept.where(rule)
    return add_date_parts(kept)


def _survived(config: RetailConfig) -> Column:
    """Number of the last step a line survives: 0 when the first rule drops it."""
    conditions = rules(config)
    step = F.when(~conditions[0], 0)
    for position, rule in enumerate(conditions[1:], start=1):
        step = step.when(~rule, position)
    return step.otherwise(len(conditions))


def cleaning_audit(raw: DataFrame, config: RetailConfig) -> DataFrame:
    """Rows, customers, orders and revenue left after each step.

    One pass: a line is tagged with the last step it survives, so an id is
    still present at step s exactly when one of its lines reached s or more.
    Lines collapse to (customer, invoice, step), and that table is staged for
    the four counts taken from it.
    """
    named = require_columns(rename_columns(trim_names(raw)))
    # Before the id cast, a customer is whatever the raw column holds.
    raw_id = F.col("CustomerID").cast("string")
    lines = typed(
        named.withColumn("_raw", F.when(raw_id != "NaN", raw_id)), config.date_formats, config.strict_nulls
    ).withColumn("_step", _survived(config))
    groups = stage(
        lines.groupBy("_raw", "CustomerID", "InvoiceNo", "_step").agg(
            F.count(F.lit(1)).alias("_rows"), F.sum(F.col("Revenue").cast(C.MONEY)).alias("_money")
        )
    )
    size = groups.groupBy("_step").agg(F.sum("_rows").alias("Rows"), F.sum("_money").alias("Money"))
    reach = _reach(groups, "CustomerID", "Customers").where("_step > 0")
    first = groups.where(F.col("_raw").isNotNull()).agg(F.countDistinct("_raw").alias("Customers"))
    customers = reach.unionByName(first.withColumn("_step", F.lit(0)))
    orders = _reach(groups, "InvoiceNo", "Orders")

    steps = raw.sparkSession.createDataFrame(list(enumerate(STEPS)), "_step int, Step string")
    # From here on there are at most seven rows.
    last_first = Window.orderBy(F.desc("_step"))
    at_least = lambda c: F.coalesce(F.sum(c).over(last_first), F.lit(0))
    table = (
        steps.join(size, "_step", "left")
        .join(orders, "_step", "left")
        .join(customers, "_step", "left")
        .select(
            "_step",
            "Step",
            at_least("Rows").alias("Rows"),
            F.when(F.col("_step") == 0, F.coalesce("Customers", F.lit(0)))
            .otherwise(F.sum(F.when(F.col("_step") > 0, F.col("Customers"))).over(last_first))
            .alias("Customers"),
            at_least("Orders").alias("Orders"),
            at_least("Money").cast("double").alias("Revenue"),
        )
    )
    before = F.lag("Rows").over(Window.orderBy("_step"))
    return table.select(
        "Step",
        "Rows",
        F.coalesce("Customers", F.lit(0)).alias("Customers"),
        "Orders",
        "Revenue",
        F.coalesce(before - F.col("Rows"), F.lit(0)).alias("RemovedRowsFromPreviousStep"),
    )


def _reach(groups: DataFrame, key: str, name: str) -> DataFrame:
    """Ids by the furthest step any of their lines reached."""
    return (
        groups.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("_step").alias("_step"))
        .groupBy("_step")
        .agg(F.count(F.lit(1)).alias(name))
    )


def missing_ids(raw: DataFrame, config: RetailConfig) -> DataFrame:
    """Null customers before and after the first rule."""
    lines = normalise(raw, config)
    missing = F.col("CustomerID").isNull()
    return lines.agg(
        F.count_if(missing).alias("MissingBefore"),
        F.count_if(missing & rules(config)[0]).alias("MissingAfter"),
    )


def cancelled_lines(raw: DataFrame, config: RetailConfig) -> DataFrame:
    """Lines the cancellation rule removes, after the first rule."""
    lines = normalise(raw, config)
    return lines.agg(F.count_if(rules(config)[0] & is_cancelled(F.col("InvoiceNo"))).alias("CancelledRows"))


def duplicate_lines(df: DataFrame) -> DataFrame:
    """Lines equal to an earlier line in every column. Nothing is removed."""
    return (
        df.groupBy(*df.columns)
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("DuplicateRows"))
    )
