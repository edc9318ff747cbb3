"""Null, id and date rules on hand-made lines."""

from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import RetailConfig
from ledgerlens.functions import columns as C
from ledgerlens.operators import clean as K, profile

CFG = RetailConfig()
NAMES = ["Invoice", "StockCode", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
UK = "United Kingdom"


def lines(spark, rows):
    schema = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


GOOD = ("536365", "85123A", "6", "2011-03-04 08:26:00", "2.55", "17850.0", UK)


def change(**kw):
    row = dict(zip(NAMES, GOOD))
    row.update({k.replace("_", " "): v for k, v in kw.items()})
    return tuple(row[n] for n in NAMES)


def test_each_rule_removes_its_lines_and_the_audit_adds_up(spark):
    rows = [
        GOOD,
        change(Customer_ID=None),
        change(Customer_ID="NaN"),
        change(InvoiceDate="soon"),
        change(Invoice="c536379"),
        change(Invoice="C536380"),
        change(Quantity="-1"),
        change(Quantity="many"),
        change(Quantity="NaN"),
        change(Price="0"),
        change(StockCode="M"),
        change(StockCode="m"),
        change(StockCode=None),
        change(Country="France"),
        change(Country=None),
        change(InvoiceDate="2009-12-31 23:59:59"),
        change(InvoiceDate="2012-01-01 00:00:00"),
    ]
    raw = lines(spark, rows)
    kept = K.clean(raw, CFG).toPandas()
    assert sorted(kept.StockCode) == ["85123A", "m", "nan"]
    assert set(kept.CustomerID) == {"17850"}
    audit = K.cleaning_audit(raw, CFG).toPandas().sort_values("Step")
    assert list(audit.Rows) == [17, 14, 12, 8, 7, 5, 3]
    assert list(audit.RemovedRowsFromPreviousStep) == [0, 3, 2, 4, 1, 2, 2]
    assert list(audit.Customers) == [1] * 7
    # Missing text becomes an id of its own only in text columns.
    assert list(audit.Orders) == [3, 3, 1, 1, 1, 1, 1]
    assert audit.Revenue.iloc[-1] == pytest.approx(3 * 6 * 2.55)


def test_strict_nulls_drops_missing_stock_codes(spark):
    raw = lines(spark, [GOOD, change(StockCode=None)])
    assert K.clean(raw, CFG).count() == 2
    assert K.clean(raw, RetailConfig(strict_nulls=True)).count() == 1


def test_audit_counts_raw_customers_before_the_id_cast(spark):
    raw = lines(spark, [GOOD, change(Customer_ID="17850.4"), change(Customer_ID="17851")])
    audit = K.cleaning_audit(raw, CFG).toPandas().sort_values("Step")
    assert list(audit.Customers)[:2] == [3, 2]


def test_names_are_trimmed_and_renamed_and_checked(spark):
    raw = lines(spark, [GOOD])
    padded = raw.toDF(*(f" {c} " for c in raw.columns))
    assert K.clean(padded, CFG).count() == 1
    with pytest.raises(KeyError, match="Quantity"):
        K.clean(raw.drop("Quantity"), CFG)


def test_extra_date_formats(spark):
    raw = lines(spark, [change(InvoiceDate="12/1/2010 8:26")])
    assert K.clean(raw, CFG).count() == 0
    got = K.clean(raw, RetailConfig(date_formats=("M/d/yyyy H:mm",))).first()
    assert got.InvoiceDate == datetime(2010, 12, 1, 8, 26) and got.MonthStart == date(2010, 12, 1)


def test_days_are_whole_and_rounded_down(spark):
    rows = [("2011-12-09 12:50:00",), ("2012-01-01 00:00:00",), ("2012-01-09 12:50:00",), ("2011-12-31 00:00:01",)]
    df = spark.createDataFrame(rows, "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    at = C.instant(date(2012, 1, 1))
    got = df.select("t", C.whole_days(F.col("t"), at).alias("d"), C.recency_months(F.col("t"), at).alias("r")).toPandas()
    expect = (pd.Timestamp("2012-01-01") - got.t).dt.days
    assert list(got.d) == list(expect) == [22, 0, -9, 0]
    assert got.r[0] == 0.7


def test_duplicates_and_missing_ids(spark):
    raw = lines(spark, [GOOD, GOOD, GOOD, change(Customer_ID=None), change(Invoice="C1")])
    assert K.duplicate_lines(raw).first()[0] == 2
    assert tuple(K.missing_ids(raw, CFG).first()) == (1, 0)
    assert K.cancelled_lines(raw, CFG).first()[0] == 1


def test_sum_of_nothing_is_zero_and_profile_of_no_lines(spark):
    none = K.clean(lines(spark, [change(Country="France")]), CFG)
    got = profile.dataset_summary(lines(spark, [GOOD]), none).first()
    assert (got.RawRows, got.CleanRows, got.TotalRevenue) == (1, 0, 0.0)


def test_variable_info_matches_pandas(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "s string, x double")
    got = profile.variable_info(df).toPandas().set_index("Column")
    assert dict(got.MissingValues) == {"s": 1, "x": 1} and dict(got.UniqueValues) == {"s": 1, "x": 2}
    rough = profile.variable_info(df, approx=True).toPandas().set_index("Column")
    assert dict(rough.UniqueValues) == {"s": 1, "x": 2}


def test_describe_and_correlation_match_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, 7.5, 3.0], "b": [2.0, 1.0, 5.0, 4.0, 4.5], "c": [3.0] * 5})
    df = spark.createDataFrame(pdf)
    got = profile.describe(df, ["a", "b"]).toPandas().set_index("Variable")
    expect = pdf.describe()
    for v in "ab":
        assert list(got.loc[v]) == pytest.approx(list(expect[v]))
    corr = profile.correlation(df, ["a", "b", "c"]).toPandas().set_index(["Variable1", "Variable2"]).Corr
    assert corr["a", "b"] == pytest.approx(pdf.a.corr(pdf.b)) == corr["b", "a"]
    assert corr["a", "a"] == pytest.approx(1.0) and pd.isna(corr["a", "c"])
    assert len(corr) == 9
