import os
import tempfile
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES
from ledgerlens.functions import columns
from ledgerlens.operators import clean as K
from ledgerlens.plans import analysis
from ledgerlens.operators import rfm
from ledgerlens.session import release, shared_folder, stage
from ledgerlens.sources import readers, sinks, snapshot
from ledgerlens.sources.retail_view import VIEW_CONFIG, retail_lines
from tests.conftest import plan_of

SAMPLE = (
    "src1_stack_parts", "prj4_lenient_casts", "aud1_cleaning_audit", "agg3_variable_info", "agg6_outlier_cut",
    "agg12_customer_product", "agg18_grade_month_revenue", "win1_running_revenue", "win7_scores", "tim3_rolling_panel",
    "tim8_rolling_abc", "tim9_mover_mix", "trn5_movement_distribution", "ml7_silhouette", "ml10_auc", "drv2_impact_summary",
)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, folder, key):
    got = QUERIES[key](spark, folder).toPandas()
    assert difference(got, connect(folder).execute(ORACLE[key]).df()) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_csv_parts_are_stacked_by_name(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("Invoice,StockCode,Price\n1,x,2.5\n2,y,bad\n")
    b.write_text("Price,Invoice\n9,3\n")
    got = readers.load_parts(spark, [str(a), str(b)], "csv").orderBy("Invoice").collect()
    assert [(r.Invoice, r.StockCode, r.Price) for r in got] == [("1", "x", "2.5"), ("2", "y", "bad"), ("3", None, "9")]
    with pytest.raises(ValueError):
        readers.load_parts(spark, [])


def test_raw_snapshot_and_overview(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0)], "Invoice string, Price double")
    readers.save_raw(df, str(tmp_path / "raw"))
    again = readers.load_raw(spark, str(tmp_path / "raw"))
    assert again.collect() == df.collect()
    rows = readers.overview(again).orderBy("Position").collect()
    assert [(r.Rows, r.Columns, r.Column, r.Dtype) for r in rows] == [(1, 2, "Invoice", "string"), (1, 2, "Price", "double")]
    assert readers.first_rows(again).count() == 1


def test_empty_reports_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([("한글", 1)], "a string, b int")
    written = sinks.save_reports({"full": df, "none": df.where("false"), "absent": None}, str(tmp_path / "out"))
    assert written == ["full"] and sorted(os.listdir(tmp_path / "out")) == ["full"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "full")).first().a == "한글"


def test_a_report_replaces_the_one_before_as_a_whole(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.5, date(2011, 1, 1)), (None, 2.0, None)], "a string, b double, c date")
    target = str(tmp_path / "out")
    sinks.save_reports({"one": df, "two": df.select("b"), "nested": df.select(F.array("b").alias("l"))}, target)
    again = sinks.read_reports(spark, target)
    assert list(again) == ["one", "two", "nested"]
    assert sorted(again["one"].collect(), key=str) == sorted(df.collect(), key=str)
    assert sorted(r.l for r in again["nested"].collect()) == ["[1.5]", "[2.0]"]
    sinks.save_reports({"two": df.select("a")}, target)
    assert sorted(os.listdir(target)) == ["two"] and list(sinks.read_reports(spark, target)) == ["two"]
    assert sinks.save_reports({"two": df.where("false")}, target) == [] and sinks.read_reports(spark, target) == {}


def test_a_broken_report_leaves_the_one_before(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    target = str(tmp_path / "out")
    sinks.save_reports({"one": df}, target)
    with pytest.raises(Exception, match="stop"):
        sinks.save_reports({"one": df.where("b > 5"), "bad": df.select(F.raise_error(F.lit("stop")).cast("string").alias("z"))}, target)
    assert sinks.read_reports(spark, target)["one"].collect() == df.collect()
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["out", "out.manifest.json"]


def test_snapshots_read_changed_parts_only(spark, tmp_path):
    a, b, target = str(tmp_path / "a"), str(tmp_path / "b.csv"), str(tmp_path / "snap")
    spark.createDataFrame([(1, 2.5)], "Invoice int, Price double").write.parquet(a)
    spark.createDataFrame([("x", 7)], "Invoice string, Quantity int").write.parquet(b)
    rows = lambda: sorted((r.Invoice, r.Price, r.Quantity) for r in snapshot.load(spark, target).collect())
    assert snapshot.refresh(spark, [a, b], target) == [a, b] and rows() == [("1", "2.5", None), ("x", None, "7")]
    assert snapshot.refresh(spark, [a, b], target) == []
    spark.createDataFrame([("y", 70)], "Invoice string, Quantity int").write.mode("overwrite").parquet(b)
    assert snapshot.stale_parts(spark, [a, b], target) == [b]
    assert snapshot.refresh(spark, [a, b], target) == [b] and rows() == [("1", "2.5", None), ("y", None, "70")]
    assert len([f for f in os.listdir(target) if f.startswith("part-")]) == 2
    # A part that is left out goes, another schema reads again, and nothing is trusted without the cache.
    assert snapshot.load_data(spark, [b], target).count() == 1 and snapshot.stale_parts(spark, [a, b], target) == [a]
    schema = "Invoice string, Quantity int"
    kind = spark.createDataFrame([], schema).schema
    assert snapshot.refresh(spark, [b], target, schema=kind) == [b] and snapshot.load(spark, target).schema == kind
    assert snapshot.load_data(spark, [a, b], target, use_cache=False).count() == 2
    with pytest.raises(ValueError):
        snapshot.refresh(spark, [], target)
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path / "none"))


def test_a_refresh_that_breaks_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    a, target = str(tmp_path / "a"), str(tmp_path / "snap")
    spark.createDataFrame([(1,)], "Invoice int").write.parquet(a)
    snapshot.refresh(spark, [a], target)
    spark.createDataFrame([(2,)], "Invoice int").write.mode("overwrite").parquet(a)
    monkeypatch.setattr(snapshot, "write_text", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        snapshot.refresh(spark, [a], target)
    assert [r.Invoice for r in snapshot.load(spark, target).collect()] == ["1"]
    monkeypatch.undo()
    assert snapshot.refresh(spark, [a], target) == [a]
    assert [r.Invoice for r in snapshot.load(spark, target).collect()] == ["2"]


def test_ids_keep_their_digits(spark):
    df = spark.createDataFrame([("17850.0",), ("17850",), ("9007199254740993",), ("17850.5",), ("x",), (None,), ("99999999999999999999",)], "id string")
    got = [r[0] for r in df.select(columns.as_id("id")).collect()]
    assert got == ["17850", "17850", "9007199254740993", "17850", None, None, None]
    assert spark.range(1).select(F.lit(17850.0).alias("id")).select(columns.as_id("id")).first()[0] == "17850"


def test_cleaning_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([], readers.RAW_SCHEMA).write.parquet(path)
    raw = spark.read.parquet(path)
    lines = K.clean(raw, VIEW_CONFIG).groupBy("YearMonth").agg(F.sum("Revenue"))
    plan = plan_of(lines)
    assert "GreaterThanOrEqual(InvoiceDate" in plan and "Description" not in plan.split("ReadSchema")[1]
    assert "Exchange" in plan and plan.count("Exchange") == 1


def test_parts_of_unlike_types_are_stacked_as_text(spark, tmp_path):
    spark.createDataFrame([(536365, 2.5)], "Invoice int, Price double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("C536379", 7)], "Invoice string, Quantity int").write.parquet(str(tmp_path / "b"))
    got = readers.load_parts(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("Invoice").collect()
    assert [(r.Invoice, r.Price, r.Quantity) for r in got] == [("536365", "2.5", None), ("C536379", None, "7")]


def test_staged_tables_lie_in_the_shared_folder_and_can_be_released(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    before = set(os.listdir(tempfile.gettempdir()))
    other = spark.newSession()
    assert stage(other.range(3)).count() == 3
    assert os.listdir(shared_folder(spark))
    kept = f"{shared_folder(spark)}-kept"
    os.rename(shared_folder(spark), kept)
    os.makedirs(shared_folder(spark))
    release(spark)
    assert not os.path.exists(shared_folder(spark))
    os.rename(kept, shared_folder(spark))
    assert not [f for f in set(os.listdir(tempfile.gettempdir())) - before if "staged" in f or "ledgerlens" in f]


def test_static_year_may_begin_inside_a_month(spark, folder):
    config = replace(VIEW_CONFIG, static_start=date(2000, 1, 15), static_end=date(2000, 12, 20))
    base = analysis.prepare(retail_lines(spark, folder), config)
    lines = base.static.join(base.rfm.select("CustomerID"), "CustomerID", "left_semi")
    want = {r.StockCode: round(r.m, 4) for r in lines.groupBy("StockCode").agg(F.sum("Revenue").alias("m")).collect()}
    months = base.product_months().where("PeriodLines > 0").groupBy("StockCode").agg(F.sum("PeriodMoney").alias("m"))
    assert {r.StockCode: round(float(r.m), 4) for r in months.collect()} == pytest.approx(want)
    plain = rfm.create_rfm(base.static, config.static_end)
    assert sorted(base.rfm_all.collect()) == sorted(plain.collect())


def test_whole_analysis(spark, folder, tmp_path):
    out = analysis.run(retail_lines(spark, folder), VIEW_CONFIG)
    written = sinks.save_reports(analysis.report_tables(out), str(tmp_path / "report"))
    assert sorted(written) == sorted(analysis.REPORT)
    assert out["df_clean"].count() == 1236
    assert out["rfm_static"].count() == out["rfm_segmented"].count() == 90
    panel = out["monthly_panel"]
    assert panel.count() == 90 * 12 and panel.where("Customer_Grade is null").count() == 0
    assert out["transition_base"].where("MovementType = 'Unknown'").count() == 0
    sizes = {r.WindowMonths: r.TrainN + r.TestN for r in out["auc_summary"].collect()}
    assert sizes == {3: 304, 6: 535, 12: 777}
