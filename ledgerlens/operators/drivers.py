"""What separates customers of one grade that move up from those that move down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.config import FEATURES
from ledgerlens.functions import columns as C
from ledgerlens.functions.hot_keys import join_hot
from ledgerlens.functions.ordered import quantile_values
from ledgerlens.operators.transitions import distribution
from ledgerlens.session import stage

# Labels of the lower and the upper half per variable.
HALVES = {
    "Recency": ("LowRecency(최근구매)", "HighRecency(오래전구매)"),
    "Frequency": ("LowFrequency(저빈도)", "HighFrequency(고빈도)"),
    "Monetary": ("LowMonetary(저매출)", "HighMonetary(고매출)"),
}


def of_grade(base: DataFrame, grade: str) -> DataFrame:
    return base.where(F.col("Customer_Grade") == grade)


def medians(rows: DataFrame, variables: Sequence[str] = FEATURES) -> dict[str, float | None]:
    values = quantile_values(rows, variables, [0.5])
    return {v: values.get((v, 0.5)) for v in variables}


def half(value: Column, cut: float | None, low: str, high: str, tie: str = "low") -> Column:
    """Label by the cut; a value equal to it goes to the `tie` side."""
    if tie not in ("low", "high"):
        raise ValueError("tie must be 'low' or 'high'")
    cut_column = F.lit(cut).cast("double")
    if tie == "low":
        return F.when(value <= cut_column, low).otherwise(high)
    return F.when(value >= cut_column, high).otherwise(low)


def _rates(kinds: Sequence[str]) -> list[Column]:
    return [C.rate(F.col("MovementType") == kind).alias(f"{kind}_Rate") for kind in kinds]


def impact_rows(rows: DataFrame, variables: Sequence[str] = FEATURES, tie: str = "low") -> DataFrame:
    """One row per input row and variable, with the variable's median half."""
    unknown = [v for v in variables if v not in HALVES]
    if unknown:
        raise ValueError(f"unknown variables {unknown}; expected some of {list(HALVES)}")
    cuts = medians(rows, variables)
    cells = F.array(
        *(
            F.struct(
                F.lit(v).alias("Variable"),
                half(F.col(v), cuts[v], *HALVES[v], tie).alias("Group"),
                F.col(v).cast("double").alias("Value"),
                F.lit(cuts[v]).cast("double").alias("Cut"),
            )
            for v in variables
        )
    )
    return rows.select("CustomerID", "MovementType", F.explode(cells).alias("_c")).select(
        "CustomerID", "MovementType", "_c.*"
    )


def impact_summary(melted: DataFrame) -> DataFrame:
    return melted.groupBy("Variable", "Group").agg(
        F.count(F.lit(1)).alias("Obs"),
        F.countDistinct("CustomerID").alias("Customers"),
        C.exact_mean(F.col("Value")).alias("Mean_Value"),
        *_rates(("Up", "Down", "NoActivity")),
        F.max("Cut").alias("Cut"),
    )


def impact_distribution(melted: DataFrame) -> DataFrame:
    # Group labels differ between variables, so the label is the key.
    return distribution(melted, "Group")


def high_monetary(rows: DataFrame) -> DataFrame:
    """Rows at or above the Monetary median, split at their own Frequency median."""
    money_cut = F.lit(medians(rows, ["Monetary"])["Monetary"]).cast("double")
    rich = rows.where(F.col("Monetary") >= money_cut)
    cut = medians(rich, ["Frequency"])["Frequency"]
    return rich.withColumn(
        "FreqGroup_in_HighM", half(F.col("Frequency"), cut, "LowF_in_HighM", "HighF_in_HighM", tie="high")
    )


def high_monetary_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("FreqGroup_in_HighM").agg(
        F.count(F.lit(1)).alias("Obs"),
        F.countDistinct("CustomerID").alias("Customers"),
        C.exact_mean(F.col("Frequency")).alias("Mean_Frequency"),
        C.exact_mean(F.col("Monetary")).alias("Mean_Monetary"),
        *_rates(("Up", "Down", "NoActivity")),
    )


def with_repeat_status(rows: DataFrame) -> DataFrame:
    return rows.withColumn("RepeatStatus", F.when(F.col("Frequency") >= 2, "Repeat").otherwise("OneTime"))


def repeat_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("RepeatStatus").agg(
        F.count(F.lit(1)).alias("Obs"),
        F.countDistinct("CustomerID").alias("Customers"),
        *(C.exact_mean(F.col(v)).alias(f"Mean_{v}") for v in FEATURES),
        *_rates(("Up", "Stay", "Down", "NoActivity")),
    )


def mover_mix(base: DataFrame, product_months: DataFrame, classes: DataFrame, grade: str, window: int) -> DataFrame:
    """A, B and C revenue shares of each customer-month of `grade` that moves up or down.

    The movers, not the purchases, are spread over their window months: the
    join then has plain equality keys and reads each purchase row once. Money
    is added up after the class is known, so purchases meet in one shuffle only.
    """
    movers = base.where((F.col("Customer_Grade") == grade) & F.col("MovementType").isin("Up", "Down")).select(
        "CustomerID",
        "AnalysisMonth",
        "MovementType",
        F.explode(
            F.sequence(F.add_months("AnalysisMonth", -window), F.add_months("AnalysisMonth", -1), F.expr("interval 1 month"))
        ).alias("MonthStart"),
    )
    bought = stage(
        movers.join(product_months, ["CustomerID", "MonthStart"]).select(
            "CustomerID", "AnalysisMonth", "MovementType", "StockCode", F.col("Money").alias("_money")
        )
    )
    known = classes.select("AnalysisMonth", "StockCode", "ABC_Class")
    total = F.col("_all").cast("double")
    return (
        # A best-seller is bought by most movers of a month.
        join_hot(bought, known, ["AnalysisMonth", "StockCode"])
        .groupBy("CustomerID", "AnalysisMonth", "MovementType")
        .agg(
            F.sum("_money").alias("_all"),
            *(F.sum(F.when(F.col("ABC_Class") == c, F.col("_money"))).alias(c) for c in "ABC"),
        )
        .where(F.col("_all") > 0)
        .select(
            "CustomerID",
            "AnalysisMonth",
            "MovementType",
            *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / total).alias(f"{c}_Share") for c in "ABC"),
        )
    )


def mover_mix_summary(detail: DataFrame) -> DataFrame:
    return detail.groupBy("MovementType").agg(
        F.count(F.lit(1)).alias("Obs"),
        F.countDistinct("CustomerID").alias("Customers"),
        *(F.avg(f"{c}_Share").alias(f"Mean_{c}_Share") for c in "ABC"),
    )
