from dataclasses import replace
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import RetailConfig
from ledgerlens.functions import columns as C
from ledgerlens.operators import products, rfm as R, scores as S
from ledgerlens.operators.facts import order_months


def lines(spark, rows):
    df = spark.createDataFrame(rows, "CustomerID string, InvoiceNo string, InvoiceDate timestamp_ntz, Revenue double")
    return df


SAMPLE = [
    ("1", "a", datetime(2011, 1, 5, 10), 10.0),
    ("1", "a", datetime(2011, 1, 5, 10), 5.5),
    ("1", "b", datetime(2011, 3, 1, 9), 1.0),
    ("2", "b", datetime(2011, 2, 1), 2.0),
    (None, "z", datetime(2011, 2, 1), 2.0),
]


def test_rfm_counts_distinct_invoices(spark):
    got = R.create_rfm(lines(spark, SAMPLE), date(2011, 4, 1)).toPandas().set_index("CustomerID")
    assert list(got.loc["1", ["Frequency", "Monetary"]]) == [2, 16.5]
    assert got.loc["1", "Recency"] == 1.0 and got.loc["2", "Recency"] == 2.0
    assert len(got) == 2


def test_snapshot_choices(spark):
    df = lines(spark, SAMPLE)
    assert R.create_rfm(df, "max").where("CustomerID = '1'").first().Recency == 0.0
    assert R.create_rfm(df, "max+1d").where("CustomerID = '2'").first().Recency == 1.0
    with pytest.raises(ValueError):
        R.create_rfm(df, "min")
    empty = R.create_rfm(df.where("false"))
    assert empty.columns == list(R.COLUMNS) and empty.count() == 0


def test_rfm_of_orders_equals_rfm_of_lines(spark):
    df = lines(spark, SAMPLE + [("1", "a", datetime(2011, 2, 3), 7.0)])  # invoice a has lines in two months
    orders = order_months(df.withColumn("MonthStart", F.trunc("InvoiceDate", "month")))
    for snapshot in (date(2011, 4, 1), "max", "max+1d"):
        a, b = R.create_rfm(df.where("CustomerID is not null"), snapshot), R.rfm_of_orders(orders, snapshot)
        assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 2


def test_idle_customers(spark):
    base = spark.createDataFrame([("1",), ("9",), ("9",)], "CustomerID string")
    got = R.with_idle(R.create_rfm(lines(spark, SAMPLE), date(2011, 4, 1)), base, 6).toPandas().set_index("CustomerID")
    assert sorted(got.index) == ["1", "9"]
    assert list(got.loc["9", ["Recency", "Frequency", "Monetary"]]) == [7.0, 0, 0.0]


def test_outlier_cut_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"CustomerID": [str(i) for i in range(500)], "Frequency": rng.integers(1, 9, 500), "Monetary": rng.random(500)})
    df = spark.createDataFrame(pdf)
    cuts = R.outlier_cutoffs(df, 0.99)
    assert cuts == pytest.approx((pdf.Frequency.quantile(0.99), pdf.Monetary.quantile(0.99)))
    kept = pdf[(pdf.Frequency <= cuts[0]) & (pdf.Monetary <= cuts[1])]
    assert R.drop_outliers(df, cuts).count() == len(kept)
    assert R.outlier_summary(df, cuts).first().RemovedCustomers == 500 - len(kept)


@pytest.mark.parametrize("n", [7, 13, 23, 100])
def test_scores_match_pandas_qcut(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame(
        {
            "CustomerID": sorted(str(i) for i in range(100, 100 + n)),
            "Recency": np.round(rng.permutation(n) / 7, 1),
            "Frequency": rng.integers(1, 4, n),
            "Monetary": rng.random(n),
        }
    )
    got = S.add_scores(spark.createDataFrame(pdf)).toPandas().sort_values("CustomerID").reset_index(drop=True)
    cut = lambda x, labels: pd.qcut(x, 5, labels=labels).astype(int)
    assert list(got.R_score) == list(cut(pdf.Recency, [5, 4, 3, 2, 1]))
    assert list(got.F_score) == list(cut(pdf.Frequency.rank(method="first"), [1, 2, 3, 4, 5]))
    assert list(got.M_score) == list(cut(pdf.Monetary, [1, 2, 3, 4, 5]))
    assert list(got.RFM_score) == [f"{r}{f}{m}" for r, f, m in zip(got.R_score, got.F_score, got.M_score)]


def test_repeated_edges_raise(spark):
    df = spark.createDataFrame([(str(i), 1.0, 1, float(i)) for i in range(10)], "CustomerID string, Recency double, Frequency int, Monetary double")
    with pytest.raises(ValueError, match="Recency"):
        S.add_scores(df)


def test_rule_segment_order(spark):
    cases = [(5, 4, 4, "VIP"), (5, 4, 3, "Loyal"), (2, 2, 5, "At-risk"), (1, 5, 1, "Loyal"), (3, 3, 3, "General"), (5, 1, 5, "General")]
    df = spark.createDataFrame(cases, "r int, f int, m int, want string")
    got = df.select("want", S.rule_segment(F.col("r"), F.col("f"), F.col("m")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_revenue_tier_and_vip(spark):
    pdf = pd.DataFrame({"CustomerID": list("abcdefgh"), "Monetary": [1.0, 2, 3, 4, 5, 6, 7, 8]})
    df = spark.createDataFrame(pdf)
    got = S.add_revenue_tier(df).toPandas().sort_values("Monetary").Segment
    assert list(got) == ["Low"] * 4 + ["Mid"] * 2 + ["VIP"] * 2
    vip = S.vip_summary(df, S.vip_threshold(df)).first()
    assert (vip.VIP_Customers, vip.VIP_Customer_Ratio) == (2, 0.25)
    assert vip.VIP_Revenue_Ratio == pytest.approx(15 / 36)


def sales(spark, rows):
    return spark.createDataFrame(rows, "StockCode string, Quantity double, Revenue double")


def test_single_product_is_class_c(spark):
    assert products.add_abc(sales(spark, [("x", 1.0, 5.0)])).first().ABC_Class == "C"


def test_class_borders_and_ties(spark):
    rows = [("d", 1.0, 5.0), ("a", 1.0, 80.0), ("b", 1.0, 10.0), ("c", 1.0, 5.0)]
    got = products.add_abc(sales(spark, rows)).toPandas().set_index("StockCode")
    assert dict(got.ABC_Class) == {"a": "A", "b": "B", "c": "B", "d": "C"}
    assert got.CumulativeRevenue["c"] == 95.0
    tail = products.long_tail(sales(spark, rows)).toPandas().set_index("StockCode").ProductRank
    assert dict(tail) == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_share_of_a_missing_class_is_null(spark):
    got = products.abc_revenue_share(products.add_abc(sales(spark, [("x", 1.0, 5.0)]))).toPandas()
    assert list(got.ABC_Class) == ["A", "B", "C"]
    assert got.Share.isna().tolist() == [True, True, False] and got.Share[2] == 1.0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_totals_and_fine_prices_keep_their_money(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        lines = spark.createDataFrame([("a", 1.0, 9e14), ("a", 1.0, 3e14), ("b", 3.0, 0.000001), ("b", 1.0, 0.000002)], "StockCode string, Quantity double, Revenue double")
        got = {r.StockCode: r for r in products.analyze_products(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got["a"].Revenue == 1.2e15 and got["b"].Revenue == 0.000003
    assert got["a"].CumulativeRevenue == 1.2e15 and got["b"].ABC_Class == "C"


def test_revenue_without_a_class_counts_in_its_segment(spark):
    pairs = spark.createDataFrame([("VIP", "A", 60.0), ("VIP", None, 40.0)], "Segment string, ABC_Class string, Revenue double")
    rows = S.segment_abc_mix(pairs).collect()
    assert [(r.ABC_Class, r.TotalRevenue, r.Ratio) for r in rows] == [("A", 100.0, 0.6)]


def test_ids_beyond_whole_numbers_are_missing(spark):
    df = spark.createDataFrame([(17850.0,), (float("inf"),), (1e20,), (float("nan"),), (None,)], "x double")
    assert [r.x for r in df.select(C.as_id("x").alias("x")).collect()] == ["17850", None, None, None, None]


def test_shifting_a_leap_day():
    assert replace(RetailConfig(), start=date(2012, 2, 29)).shifted(1).start == date(2013, 2, 28)
