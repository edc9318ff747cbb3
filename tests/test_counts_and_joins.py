import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.queries import QUERIES
from ledgerlens.functions import columns
from ledgerlens.functions.distinct import distinct_by_group, nulls_and_values
from ledgerlens.functions.hot_keys import hot_keys, join_hot
from ledgerlens.operators import clean as cleaning, drivers, profile, rfm
from ledgerlens.session import stage
from tests.conftest import plan_of


def lines(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [
        (r.choice([2009, 2010, 2011, None]), f"c{r.randint(0, 30)}" if r.random() < 0.9 else None, f"i{r.randint(0, 90)}", f"s{r.randint(0, 12)}", r.uniform(-5, 900), datetime(2010, 1, 1 + k % 28), float(k % 7))
        for k in range(n)
    ]
    return rows, spark.createDataFrame(rows, "Year int, CustomerID string, InvoiceNo string, StockCode string, Revenue double, InvoiceDate timestamp_ntz, Quantity double")


def test_distinct_counts_by_group_and_overall(spark):
    rows, df = lines(spark)
    got = {r.Group: r.Count for r in distinct_by_group(df, "CustomerID", F.col("Year"), [2009, 2010, 2011, 2012]).collect()}
    want = {y: len({r[1] for r in rows if r[0] == y and r[1]}) for y in (2009, 2010, 2011, 2012)}
    assert got == want | {None: len({r[1] for r in rows if r[1]})}


def test_more_groups_than_bits_of_a_bitmap(spark):
    df = spark.range(1000).select((F.col("id") % 200).cast("int").alias("g"), (F.col("id") % 300).cast("string").alias("v"))
    got = {r.Group: r.Count for r in distinct_by_group(df, "v", F.col("g"), list(range(200))).collect()}
    want = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    assert got == want | {None: 300}


def test_profile_plans_hold_no_expand_and_no_melted_lines(spark):
    _, df = lines(spark)
    for made in (profile.dataset_summary(df, df), profile.yearly_summary(df), profile.variable_info(df)):
        assert "Expand" not in plan_of(made)
    assert "Generate" not in plan_of(profile.variable_info(df))


def test_variable_info_counts_nulls_and_values(spark):
    rows, df = lines(spark)
    got = {r.Column: (r.Position, r.Dtype, r.MissingValues, r.UniqueValues) for r in profile.variable_info(df).collect()}
    for k, (name, kind) in enumerate(df.dtypes):
        values = [r[k] for r in rows]
        assert got[name] == (k, kind, values.count(None), len({v for v in values if v is not None}))
    one = nulls_and_values(df.where("false"), "Year").first()
    assert (one.MissingValues, one.UniqueValues) == (0, 0)
    rough = {r.Column: r.MissingValues for r in profile.variable_info(df, approx=True).collect()}
    assert rough == {c: got[c][2] for c in rough}


def test_yearly_summary_of_nothing(spark):
    _, df = lines(spark)
    assert profile.yearly_summary(df.where("false")).collect() == []
    assert profile.dataset_summary(df, df.where("false")).first().CleanCustomers == 0


def test_moments_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(4)
    values = [(float(x), float(y), float(x * 0.3 + y)) for x, y in zip(rng.lognormal(8, 3, 3000), rng.normal(1e6, 1, 3000))]
    df = spark.createDataFrame(values, "a double, b double, c double")
    columns = ["a", "b", "c"]
    results = [
        (sorted(profile.describe(d, columns).collect()), sorted(profile.correlation(d, columns).collect()))
        for d in (df.coalesce(1), df.repartition(13, "a"), df.orderBy(F.desc("c")))
    ]
    assert results[0] == results[1] == results[2]
    x = np.array(values)
    for r in results[0][0]:
        own = x[:, columns.index(r.Variable)]
        assert (r.Mean, r.Std) == pytest.approx((own.mean(), own.std(ddof=1)), rel=1e-9)
    corr = np.corrcoef(x.T)
    for r in results[0][1]:
        assert r.Corr == pytest.approx(corr[columns.index(r.Variable1), columns.index(r.Variable2)], abs=1e-8)


def test_joins_with_hot_keys_equal_plain_joins(spark):
    rows = [("hot", k) for k in range(600)] + [(f"k{k % 50}", k) for k in range(300)] + [(None, k) for k in range(200)]
    left = spark.createDataFrame(rows, "k string, v int").repartition(6)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), ("other", 4), (None, 5)], "k string, w int")
    assert [r.k for r in hot_keys(left.where("k is not null"), ["k"], 10).collect()] == ["hot"]
    for how in ("inner", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert sorted(map(tuple, join_hot(left, right, ["k"], how, 10).collect()), key=str) == want
    with pytest.raises(ValueError):
        join_hot(left, right, ["k"], "left")
    assert join_hot(left.where("false"), right, ["k"]).count() == 0


def largest_share(df, by="part"):
    """Share of the rows in the fullest partition of a result."""
    counts = [r["count"] for r in df.withColumn(by, F.spark_partition_id()).groupBy(by).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture()
def plain_shuffles(spark):
    """Without what adaptive execution or a broadcast would do for a hot key."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_customer_with_most_lines_does_not_fill_one_task(spark, plain_shuffles):
    rows = [("big", k) for k in range(6000)] + [(f"c{k % 1500}", k) for k in range(6000)]
    df = stage(spark.createDataFrame(rows, "CustomerID string, n int").repartition(16))
    cohort = spark.createDataFrame([("big",)] + [(f"c{k}",) for k in range(1000)], "CustomerID string")
    kept = rfm.lines_of_customers(df, cohort)
    assert kept.count() == 6000 + sum(k % 1500 < 1000 for k in range(6000))
    assert largest_share(kept) < 0.2 < 0.4 < largest_share(rfm.of_customers(df, cohort))


def test_a_best_seller_does_not_fill_one_task(spark, plain_shuffles):
    bought = stage(spark.createDataFrame([(1, "best", k) for k in range(6000)] + [(1 + k % 3, f"p{k % 900}", k) for k in range(6000)], "AnalysisMonth int, StockCode string, v int").repartition(16))
    classes = bought.select("AnalysisMonth", "StockCode").distinct().withColumn("ABC_Class", F.lit("A"))
    keys = ["AnalysisMonth", "StockCode"]
    assert largest_share(join_hot(bought, classes, keys)) < 0.2 < 0.4 < largest_share(bought.join(classes, keys))
    assert drivers.join_hot is join_hot


def test_ids_are_read_as_text_only_where_that_can_succeed(spark):
    odd = ["17850", "17850.0", " 12\t", "\x1f-7\x0b", "+5\n", "12.", ".5", "1e3", "0x1F", "1 2", "", " ", "NaN", "Infinity", "5\xa0", "9223372036854775808", "12d", None]
    df = spark.createDataFrame([(v,) for v in odd], "id string")
    plain = F.expr("case when not isnan(try_cast(id as double)) then cast(coalesce(try_cast(id as bigint), try_cast(try_cast(id as double) as bigint)) as string) end")
    rows = df.select("id", columns.as_id("id").alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    # Each failed cast is an exception inside Spark; the text of a double never is a whole number.
    assert "RLIKE" in plan_of(df.select(columns.as_id("id")))


def test_lines_meet_their_customers_in_one_read_where_no_key_is_hot(spark, folder):
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 2).withColumnRenamed("id", "k")
    met = join_hot(left, right, ["k"], "left_semi")
    assert met.count() == 500 and "Union" not in plan_of(met)
    # The lines are built from the raw tables once, for the cut of customers and for the join.
    files = lambda name: [f for f in QUERIES[name](spark, folder).inputFiles() if "lineitem" in f]
    assert files("flt8_cohort_lines") == []


def test_described_lines_are_built_once(spark, folder, monkeypatch):
    seen = []
    whole = profile.describe
    monkeypatch.setattr(profile, "describe", lambda df, *rest, **more: seen.append(df.inputFiles()) or whole(df, *rest, **more))
    assert QUERIES["agg20_describe_lines"](spark, folder).count() == 3
    assert seen and not any("lineitem" in f for files in seen for f in files)


def test_number_ids_are_not_read_as_text(spark):
    values = [17850.0, 17850.5, -0.0, -3.7, float("nan"), float("inf"), 9.3e18, 1e7, 123456789012345680.0, None]
    df = spark.createDataFrame([(v,) for v in values], "id double")
    got = df.select("id", columns.as_id("id").alias("want"), columns.as_id("id", floating=True).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got] and got[0].got == got[1].got == "17850"
    raw = df.select(F.col("id").alias("CustomerID"), *(F.lit("1").alias(c) for c in cleaning.REQUIRED if c != "CustomerID"))
    assert "RLIKE" not in plan_of(cleaning.typed(raw))


def test_purchases_of_movers_meet_without_a_shuffle_of_their_sums(spark, monkeypatch):
    """Money of two window months and two classes, and a purchase table that no aggregate built."""
    plans = []
    monkeypatch.setattr(drivers, "stage", lambda df: plans.append(plan_of(df)) or stage(df))
    base = spark.createDataFrame([("1", date(2011, 5, 1), "L", "Up"), ("2", date(2011, 5, 1), "L", "Stay")], "CustomerID string, AnalysisMonth date, Customer_Grade string, MovementType string")
    bought = [("1", "a", date(2011, 3, 1), 2), ("1", "a", date(2011, 4, 1), 4), ("1", "b", date(2011, 4, 1), 2), ("1", "a", date(2011, 5, 1), 90), ("2", "a", date(2011, 4, 1), 7)]
    months = spark.createDataFrame(bought, "CustomerID string, StockCode string, MonthStart date, m int").withColumn("Money", F.col("m").cast(columns.MONEY))
    classes = spark.createDataFrame([(date(2011, 5, 1), "a", "A"), (date(2011, 5, 1), "b", "C")], "AnalysisMonth date, StockCode string, ABC_Class string")
    rows = drivers.mover_mix(base, months, classes, "L", 2).collect()
    assert [(r.CustomerID, r.A_Share, r.B_Share, r.C_Share) for r in rows] == [("1", 0.75, 0.0, 0.25)]
    assert "Aggregate" not in plans[0]


def test_the_report_joins_its_raw_lines_once(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.analysis, "run", lambda raw, *_: seen.append(plan_of(raw)) or {})
    queries._results(spark, folder)
    assert "Join" not in seen[0]
