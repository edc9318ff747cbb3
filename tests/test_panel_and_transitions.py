from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import GRADE_NAMES
from ledgerlens.operators import drivers, facts, panel as P, transitions as T
from ledgerlens.operators.clean import add_date_parts
from tests.conftest import plan_of

L1, L2, L3, L4, L5 = GRADE_NAMES
FIRST, LAST = date(2011, 1, 1), date(2011, 4, 1)


def random_lines(spark, n=600, seed=0):
    """Some invoices have lines in several months; one customer owns a third."""
    rng = np.random.default_rng(seed)
    days = pd.Timestamp("2010-01-01") + pd.to_timedelta(rng.integers(0, 550 * 24, n), unit="h")
    pdf = pd.DataFrame(
        {
            "CustomerID": np.where(rng.random(n) < 0.33, "hot", rng.integers(0, 12, n).astype(str)),
            "InvoiceNo": rng.integers(0, 60, n).astype(str),
            "StockCode": rng.integers(0, 20, n).astype(str),
            "Quantity": 1.0,
            "InvoiceDate": days,
            "Revenue": rng.integers(1, 1000, n) / 100,
        }
    )
    df = spark.createDataFrame(pdf).withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    return pdf, add_date_parts(df)


def brute_window(pdf, month, width):
    month = pd.Timestamp(month)
    w = pdf[(pdf.InvoiceDate >= month - pd.DateOffset(months=width)) & (pdf.InvoiceDate < month)]
    g = w.groupby("CustomerID").agg(First=("InvoiceDate", "min"), Last=("InvoiceDate", "max"), F=("InvoiceNo", "nunique"), M=("Revenue", "sum"))
    g["R"] = ((month - g.Last).dt.days / 30).round(1)
    return g


@pytest.mark.parametrize("width", [3, 6])
def test_rolling_panel_equals_one_window_at_a_time(spark, width):
    pdf, lines = random_lines(spark)
    customers = lines.select("CustomerID").distinct()
    months = facts.customer_months(facts.order_months(lines), 12)
    got = P.rolling_rfm(months, customers, FIRST, LAST, width).toPandas()
    assert len(got) == pdf.CustomerID.nunique() * 4
    for month, rows in got.groupby("AnalysisMonth"):
        expect = brute_window(pdf, month, width)
        rows = rows.set_index("CustomerID")
        active = rows[rows.Frequency > 0]
        assert set(active.index) == set(expect.index)
        assert (active.Frequency == expect.F.loc[active.index]).all()
        assert list(active.Monetary) == pytest.approx(list(expect.M.loc[active.index]))
        assert list(active.Recency) == pytest.approx(list(expect.R.loc[active.index]))
        assert (active.FirstPurchaseDate == expect.First.loc[active.index]).all()
        idle = rows[rows.Frequency == 0]
        assert (idle.Recency == width + 1).all() and (idle.Monetary == 0).all()


def test_snapshot_panel_and_target(spark):
    pdf, lines = random_lines(spark, seed=1)
    months = facts.customer_months(facts.order_months(lines), 12)
    got = P.snapshot_panel(months, FIRST, LAST, [3, 12]).toPandas()
    for (month, width), rows in got.groupby(["BaseMonth", "WindowMonths"]):
        expect = brute_window(pdf, month, width)
        rows = rows.set_index("CustomerID")
        assert set(rows.index) == set(expect.index)
        assert (rows.Frequency == expect.F.loc[rows.index]).all()
        start = pd.Timestamp(month) + pd.DateOffset(months=1)
        later = pdf[(pdf.InvoiceDate >= start) & (pdf.InvoiceDate < start + pd.DateOffset(months=1))]
        assert (rows.TargetBuyNextMonth == rows.index.isin(later.CustomerID).astype(int)).all()
    near = P.snapshot_panel(months, FIRST, FIRST, [12], gap_months=0).toPandas().set_index("CustomerID")
    now = pdf[pdf.InvoiceDate.dt.strftime("%Y-%m") == "2011-01"]
    assert (near.TargetBuyNextMonth == near.index.isin(now.CustomerID).astype(int)).all()


def test_month_range(spark):
    assert [r[0] for r in P.month_range(spark, FIRST, LAST).collect()] == [date(2011, m, 1) for m in (1, 2, 3, 4)]


def graded(spark, rows):
    return spark.createDataFrame(rows, "CustomerID string, AnalysisMonth date, Customer_Grade string")


MOVES = [
    ("a", date(2011, 1, 1), L3),
    ("a", date(2011, 2, 1), L4),
    ("a", date(2011, 4, 1), L2),  # March is missing
    ("b", date(2011, 1, 1), L3),
    ("b", date(2011, 2, 1), L3),
    ("b", date(2011, 3, 1), L1),
    ("c", date(2011, 1, 1), L3),
    ("c", date(2011, 2, 1), "other"),
]


def test_next_grade_needs_the_very_next_month(spark):
    got = T.with_next_grade(graded(spark, MOVES)).toPandas().sort_values(["CustomerID", "AnalysisMonth"])
    assert list(got.MovementType) == ["Up", "NoActivity", "NoActivity", "Stay", "Down", "NoActivity", "Unknown", "NoActivity"]
    assert list(got.Moved) == [1, 1, 1, 0, 1, 1, 1, 1]
    assert list(got.CurrentGradeNum)[:2] == [3, 4]


def test_last_month_can_be_left_out(spark):
    got = T.with_next_grade(graded(spark, MOVES), exclude_censored=True).toPandas()
    assert len(got) == 7 and got.AnalysisMonth.max() == date(2011, 3, 1)


def test_mobility_and_distribution(spark):
    base = T.with_next_grade(graded(spark, MOVES))
    summary = T.mobility_summary(base).toPandas().set_index("Customer_Grade")
    assert tuple(summary.loc[L3]) == (3, 4, 0.75)
    dist = T.distribution(base, "Customer_Grade").toPandas()
    assert list(dist.groupby("Customer_Grade").Ratio.sum()) == pytest.approx([1.0] * dist.Customer_Grade.nunique())
    wide = T.transition_matrix(base, L3).first()
    assert (wide[L4], wide[L3], wide[L1], wide["NoActivity"]) == (1, 1, 1, 0)
    ratios = T.transition_ratios(base, L3).toPandas()
    assert ratios.Ratio.sum() == pytest.approx(1.0)


def test_revenue_share_counts_only_months_with_the_grade(spark):
    rows = [("2011-01", L1, 1.0), ("2011-01", L2, 3.0), ("2011-02", L2, 5.0)]
    df = spark.createDataFrame(rows, "AnalysisMonthStr string, Customer_Grade string, Monetary double")
    got = dict(T.revenue_share_by_grade(df).collect())
    assert got == {L1: 25.0, L2: 87.5}
    # Rows without a grade count in the month's revenue.
    df = df.union(spark.createDataFrame([("2011-02", None, 5.0)], df.schema))
    assert dict(T.revenue_share_by_grade(df).collect()) == {L1: 25.0, L2: 62.5}


def test_median_split_ties(spark):
    df = spark.createDataFrame([("a", "Up", 1.0), ("b", "Down", 2.0), ("c", "Stay", 2.0), ("d", "Up", 9.0)], "CustomerID string, MovementType string, Recency double")
    melted = drivers.impact_rows(df, ["Recency"]).toPandas().set_index("CustomerID")
    assert melted.Group.str.startswith("Low").tolist() == [True, True, True, False]
    high = drivers.impact_rows(df, ["Recency"], tie="high").toPandas().set_index("CustomerID")
    assert high.Group.str.startswith("Low").tolist() == [True, False, False, False]
    with pytest.raises(ValueError):
        drivers.impact_rows(df, ["Speed"])
    summary = drivers.impact_summary(drivers.impact_rows(df, ["Recency"])).toPandas().set_index("Group")
    low = summary[summary.index.str.startswith("Low")].iloc[0]
    assert (low.Obs, low.Up_Rate) == (3, pytest.approx(1 / 3))


def test_no_movers_give_no_mix(spark):
    _, lines = random_lines(spark, 50)
    base = T.with_next_grade(graded(spark, MOVES[3:4]))
    bought = facts.product_months(lines)
    classes = spark.createDataFrame([], "AnalysisMonth date, StockCode string, ABC_Class string")
    mix = drivers.mover_mix(base, bought, classes, L3, 6)
    assert mix.count() == 0 and drivers.mover_mix_summary(mix).count() == 0


def test_plans_have_no_loop_joins_and_no_python(spark):
    _, lines = random_lines(spark, 50)
    months = facts.customer_months(facts.order_months(lines), 12)
    panel = P.rolling_rfm(months, lines.select("CustomerID").distinct(), FIRST, LAST, 6)
    snap = P.snapshot_panel(months, FIRST, LAST, [3, 6, 12])
    for df in (panel, snap):
        plan = plan_of(df)
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "SinglePartition", "Python", "InPandas"))
