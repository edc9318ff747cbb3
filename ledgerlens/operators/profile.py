"""Descriptive tables over raw and clean lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions import columns as C
from ledgerlens.functions.distinct import distinct_by_group, nulls_and_values
from ledgerlens.functions.ordered import exact_quantiles


_COUNTED = (("CustomerID", "Customers"), ("InvoiceNo", "Orders"), ("StockCode", "SKUs"))


def dataset_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row of sizes. `clean` is read once per counted column and should be staged."""
    raw_size = raw.agg(F.count(F.lit(1)).alias("RawRows"))
    kept = clean.agg(
        F.count(F.lit(1)).alias("CleanRows"),
        C.exact_sum(F.col("Revenue")).alias("TotalRevenue"),
        F.min("InvoiceDate").alias("StartDate"),
        F.max("InvoiceDate").alias("EndDate"),
    )
    # One row from each side, brought together without a join.
    sizes = [distinct_by_group(clean, c, F.lit(0), []).select(F.col("Count").alias(f"Clean{name}")) for c, name in _COUNTED]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [raw_size, kept, *sizes])
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).select(
        "RawRows",
        "CleanRows",
        (F.col("RawRows") - F.col("CleanRows")).alias("RemovedRowsTotal"),
        "CleanCustomers",
        "CleanOrders",
        "CleanSKUs",
        "TotalRevenue",
        "StartDate",
        "EndDate",
    )


def yearly_summary(clean: DataFrame) -> DataFrame:
    """One row per year. `clean` is read once per counted column and should be staged."""
    money = clean.groupBy("Year").agg(F.count(F.lit(1)).alias("Rows"), C.exact_sum(F.col("Revenue")).alias("Revenue"))
    years = sorted(r.Year for r in clean.select("Year").distinct().collect() if r.Year is not None)
    if not years:
        return money.select("Year", "Rows", *(F.lit(0).cast("long").alias(name) for _, name in _COUNTED), "Revenue")
    counts = [distinct_by_group(clean, c, F.col("Year"), years).where("Group is not null").select(F.col("Group").alias("Year"), F.lit(name).alias("Of"), "Count") for c, name in _COUNTED]
    # A few rows per year.
    wide = reduce(DataFrame.unionByName, counts).groupBy("Year").pivot("Of", [name for _, name in _COUNTED]).agg(F.max("Count"))
    return money.join(F.broadcast(wide), "Year", "left").select("Year", "Rows", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for _, name in _COUNTED), "Revenue")


def variable_info(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, nulls and distinct non-null values of every column.

    Exact counts group each column by itself, in its own type, so a columnar table is read once in all and equal
    values meet in the tasks first. `approx=True` keeps one sketch per column instead.
    """
    if approx:
        one_row = df.agg(*(a for i, c in enumerate(df.columns) for a in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}"), F.approx_count_distinct(f"`{c}`").alias(f"_u{i}"))))
        sized = [(F.col(f"_m{i}"), F.col(f"_u{i}")) for i in range(len(df.columns))]
        cells = [F.struct(*_described(i, f), m.alias("MissingValues"), u.alias("UniqueValues")) for (i, f), (m, u) in zip(enumerate(df.schema), sized)]
        return one_row.select(F.explode(F.array(*cells)).alias("_e")).select("_e.*")
    parts = [nulls_and_values(df, f.name).select(*_described(i, f), "MissingValues", "UniqueValues") for i, f in enumerate(df.schema)]
    return reduce(DataFrame.unionByName, parts)


def _described(position: int, field) -> list:
    return [F.lit(position).alias("Position"), F.lit(field.name).alias("Column"), F.lit(field.dataType.simpleString()).alias("Dtype")]


def monthly_sales(clean: DataFrame) -> DataFrame:
    return clean.groupBy("YearMonth").agg(C.exact_sum(F.col("Revenue")).alias("Revenue"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("Count"))
    return counted.orderBy(F.desc("Count"), column)


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact means as driver values, one per column."""
    one = df.agg(*((_exact(F.col(c)) / F.nullif(F.count(c), F.lit(0))).alias(f"_{i}") for i, c in enumerate(columns))).first()
    return {c: one[f"_{i}"] for i, c in enumerate(columns)}


def _exact(value):
    """A sum of doubles that does not depend on the order of its rows."""
    return F.sum(F.when(~F.isnan(value.cast("double")), value.cast("decimal(38,12)"))).cast("double")


def describe(df: DataFrame, columns: Sequence[str], narrow: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column.

    Sums are decimals and deviations are taken from the mean in a second pass, so no digit depends on how rows are
    dealt. Set `narrow` for tables of lines (see `exact_quantiles`). `df` is read several times and should be staged.
    """
    means = _means(df, columns)
    melted = df.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(c).alias("Variable"), F.col(c).cast("double").alias("_v"), F.lit(means[c]).cast("double").alias("_mean"))
                    for c in columns
                )
            )
        ).alias("_e")
    ).select("_e.*")
    gap = F.col("_v") - F.col("_mean")
    moments = melted.groupBy("Variable").agg(
        F.count("_v").alias("Count"),
        F.max("_mean").alias("Mean"),
        F.sqrt(_exact(gap * gap) / F.nullif(F.count("_v") - 1, F.lit(0))).alias("Std"),
        F.min("_v").alias("Min"),
        F.max("_v").alias("Max"),
    )
    quartiles = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75], narrow=narrow)
        .groupBy("Variable")
        .agg(*(F.max(F.when(F.col("Prob") == p, F.col("Value"))).alias(n) for p, n in ((0.25, "Q25"), (0.5, "Median"), (0.75, "Q75"))))
    )
    return moments.join(quartiles, "Variable", "left").select(
        "Variable", "Count", "Mean", "Std", "Min", "Q25", "Median", "Q75", "Max"
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, in long form. Sums are as in `describe`."""
    pairs = list(combinations_with_replacement(columns, 2))
    whole = df.where(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0)
    means = _means(whole, columns)
    gap = lambda c: F.col(c).cast("double") - F.lit(means[c]).cast("double")
    one_row = whole.agg(*(_exact(gap(a) * gap(b)).alias(f"{a}|{b}") for a, b in pairs))
    # A constant column has no correlation: null.
    own = lambda c: F.col(f"`{c}|{c}`")
    cells = []
    for a, b in pairs:
        value = F.col(f"`{a}|{b}`") / F.nullif(F.sqrt(own(a) * own(b)), F.lit(0.0))
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("Variable1"), F.lit(right).alias("Variable2"), value.alias("Corr")))
    return one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
