"""Distributed ranks, running sums and quantiles against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import ordered
from ledgerlens.functions.ordered import add_rank, add_running_sums, exact_quantiles, quantile_values
from tests.conftest import plan_of

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def frame(seed, n=3000):
    """A third of all rows share one group and one value."""
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.34
    return pd.DataFrame(
        {
            "g": np.where(hot, 1, rng.integers(0, 5, n)),
            "id": rng.permutation(n),
            "v": np.where(hot, 7, rng.integers(0, 50, n)),
        }
    )


@pytest.mark.parametrize("seed", [0, 1])
def test_rank_and_running_sum(spark, seed):
    pdf = frame(seed)
    df = spark.createDataFrame(pdf).repartition(7)
    order = [F.col("v").desc(), F.col("id")]
    expect = pdf.sort_values(["v", "id"], ascending=[False, True])

    whole = add_rank(df, order).toPandas().sort_values("Rank")
    assert list(whole.id) == list(expect.id) and list(whole.Rank) == list(range(1, len(pdf) + 1))

    grouped = add_running_sums(df, {"run": "v"}, order, ["g"], {"all": "v"}).toPandas().set_index("id")
    expect = expect.assign(run=expect.groupby("g").v.cumsum(), all=expect.groupby("g").v.transform("sum")).set_index("id")
    assert (grouped.run == expect.run.loc[grouped.index]).all()
    assert (grouped["all"] == expect["all"].loc[grouped.index]).all()

    ranks = add_rank(df, order, ["g"]).toPandas().set_index("id").Rank
    expect_rank = expect.assign(one=1).groupby("g").one.cumsum()
    assert (ranks == expect_rank.loc[ranks.index]).all()


def test_same_result_with_many_range_parts(spark):
    pdf = frame(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(pdf)
        got = add_running_sums(df, {"run": "v"}, [F.col("v"), F.col("id")]).toPandas().sort_values(["v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert list(got.run) == list(got.v.cumsum())


@SLOW
@given(
    values=st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=40),
    probs=st.lists(st.sampled_from([0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0]), min_size=1, max_size=4, unique=True),
)
def test_quantiles_match_pandas(spark, values, probs):
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = quantile_values(df, ["x"], probs)
    for p in probs:
        assert got["x", p] == pytest.approx(pd.Series(values).quantile(p), rel=1e-9, abs=1e-9)


def test_quantiles_per_group_leave_out_missing(spark):
    pdf = frame(5, 400)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 9 != 0, F.col("v").cast("double")))
    df = df.withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v")).otherwise(float("nan")))
    got = exact_quantiles(df, ["v"], [0.5, 0.9], ["g"]).toPandas().set_index(["g", "Prob"]).Value
    kept = pdf[(pdf.id % 9 != 0) & (pdf.id % 7 != 0)]
    expect = kept.groupby("g").v.quantile([0.5, 0.9])
    assert list(got.sort_index()) == pytest.approx(list(expect.sort_index()))


def test_narrowed_quantiles_are_as_exact(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "x": np.where(rng.random(n) < 0.34, 5.0, rng.normal(0, 9, n)), "y": rng.integers(0, 3, n)})
    probs = [0.0, 0.2, 0.5, 0.5001, 0.99, 1.0]
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["x", "y"], probs, ["g"], narrow=True).toPandas().set_index(["Variable", "g", "Prob"]).Value
    assert len(got) == 24
    for v in "xy":
        for g, part in pdf.groupby("g"):
            for p in probs:
                assert got[v, g, p] == pytest.approx(part[v].quantile(p), abs=1e-12)


def test_quantile_between_equal_values_is_that_value(spark):
    df = spark.createDataFrame([(0.1,)] * 7, "x double")
    assert quantile_values(df, ["x"], [0.33])["x", 0.33] == 0.1


def test_no_rows_give_no_quantiles(spark):
    assert quantile_values(spark.createDataFrame([], "x double"), ["x"], [0.5]) == {}


def test_rows_never_meet_on_one_task(spark):
    df = spark.createDataFrame(frame(0))
    plan = plan_of(add_running_sums(df, {"run": "v"}, [F.col("v"), F.col("id")]))
    # Only the per-part totals may be gathered, below their own aggregation.
    for chunk in plan.split("SinglePartition")[1:]:
        assert "HashAggregate" in chunk.split("Scan")[0] or "HashAggregate" in chunk
    assert plan.count("Exchange SinglePartition") <= 1


@pytest.mark.parametrize("gathered", [20_000, 50])
def test_quantiles_of_several_columns_by_selection(spark, monkeypatch, gathered):
    monkeypatch.setattr(ordered, "_GATHERED", gathered)
    rng = np.random.default_rng(12)
    n = 3001
    pdf = pd.DataFrame({"a": rng.lognormal(5, 4, n), "b": rng.integers(0, 6, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.5, rng.normal(0, 3, n)), "d": rng.random(n)})
    pdf.loc[pdf.index % 9 == 0, "d"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    got = quantile_values(df, list("abcd"), probs)
    for c in "abcd":
        for p in probs:
            assert got[c, p] == pytest.approx(np.nanquantile(pdf[c], p), rel=1e-12)
