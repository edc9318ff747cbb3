"""One Spark query per operator, over the retail view of the given tables."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import fixed
from ledgerlens.config import FEATURES, GRADE_NAMES
from ledgerlens.functions import columns as C
from ledgerlens.operators import clean as cleaning
from ledgerlens.operators import drivers, facts, grades, kmeans, panel as panels, predict, products, profile
from ledgerlens.operators import rfm as rfms, scores, segments, silhouette, transitions
from ledgerlens.plans import analysis
from ledgerlens.session import shared_folder, stage
from ledgerlens.sources import readers, sinks, snapshot
from ledgerlens.sources.retail_view import VIEW_CONFIG as CFG, retail_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MONEY = "decimal(18,4)"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """One form for comparison across engines: bigint, six decimal places, dates as text.

    A unit price is a plain quotient, equal in every engine, and stays as it is.
    """
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType) and f.name != "UnitPrice":
            c = F.round(c, 6)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def clean(spark, folder) -> DataFrame:
    return cleaning.clean(retail_lines(spark, folder), CFG)


def base(spark, folder) -> analysis.Base:
    return analysis.prepare(retail_lines(spark, folder), CFG)


def graded_static(b) -> DataFrame:
    return grades.apply_grades(b.rfm, [fixed.model()], GRADE_NAMES)


def graded_panel(b) -> DataFrame:
    return grades.apply_grades(analysis.rolling_panel(b), [fixed.model()], GRADE_NAMES)


def moves(spark, folder) -> DataFrame:
    return transitions.with_next_grade(graded_panel(base(spark, folder)))


def target_rows(spark, folder) -> DataFrame:
    return stage(drivers.of_grade(moves(spark, folder), CFG.target_grade))


def pairs(b) -> DataFrame:
    bought = stage(b.static_pairs())
    return products.integrate(bought, graded_static(b), products.analyze_products(bought))


def totals(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("Rows"),
        F.countDistinct("CustomerID").alias("Customers"),
        C.exact_sum(F.col("Revenue")).alias("Revenue"),
    )


# --- sources and sinks -------------------------------------------------------


def _scratch(spark, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _written_parts(spark, folder) -> list[str]:
    """The raw view as two parts of unlike types: numbers in the early one, text without a country in the late one."""
    raw = retail_lines(spark, folder)
    early = F.col("InvoiceDate") < C.instant(CFG.static_start)
    paths = [_scratch(spark, "early"), _scratch(spark, "late")]
    raw.where(early).write.parquet(paths[0])
    readers.as_text(raw.where(~early).drop("Country")).write.parquet(paths[1])
    return paths


@query
def src1_stack_parts(spark, folder):
    both = readers.load_parts(spark, _written_parts(spark, folder))
    return both.groupBy("Country").agg(F.count(F.lit(1)).alias("Rows"), F.sum(F.col("Quantity").try_cast("double")).alias("Quantity"))


@query
def src1_refreshed_snapshot(spark, folder):
    """A snapshot of two parts, one of which then loses the lines of more than 25 pieces: what is read again, and what is there."""
    paths, target = _written_parts(spark, folder), _scratch(spark, "snapshot")
    runs = [("first", snapshot.refresh(spark, paths, target)), ("unchanged", snapshot.refresh(spark, paths, target))]
    late = stage(spark.read.parquet(paths[1]))
    late.where(F.col("Quantity").try_cast("double") <= 25).write.mode("overwrite").parquet(paths[1])
    runs.append(("changed", snapshot.refresh(spark, paths, target)))
    again = snapshot.load_data(spark, paths, target)
    rows = again.groupBy().agg(F.count(F.lit(1)).alias("Rows"), F.sum(F.col("Quantity").try_cast("double")).alias("Quantity"))
    read = F.array(*(F.struct(F.lit(name).alias("Run"), F.lit(len(parts)).alias("PartsRead")) for name, parts in runs))
    return rows.select(F.explode(read).alias("_e"), "Rows", "Quantity").select("_e.*", "Rows", "Quantity")


@query
def src2_raw_snapshot(spark, folder):
    path = os.path.join(shared_folder(spark), f"raw-{uuid.uuid4().hex}")
    readers.save_raw(retail_lines(spark, folder), path)
    again = readers.load_raw(spark, path)
    return again.groupBy("Country").agg(F.count(F.lit(1)).alias("Rows"), F.sum("Quantity").alias("Quantity"))


@query
def src3_overview(spark, folder):
    return readers.overview(retail_lines(spark, folder))


@query
def src3_first_rows(spark, folder):
    lines = retail_lines(spark, folder).select("Invoice", "StockCode", "Quantity").orderBy("Invoice", "StockCode", "Quantity")
    return readers.first_rows(lines)


@query
def snk1_table_sink(spark, folder):
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    sinks.save_table(profile.monthly_sales(clean(spark, folder)), path)
    return spark.read.option("header", True).schema("YearMonth string, Revenue double").csv(path)


# --- projections and filters -------------------------------------------------


@query
def prj2_trim_and_alias(spark, folder):
    raw = retail_lines(spark, folder)
    padded = raw.toDF(*(f" {c} " for c in raw.columns))
    named = cleaning.require_columns(cleaning.rename_columns(cleaning.trim_names(padded)))
    return named.groupBy("InvoiceNo").agg(F.count("CustomerID").alias("Lines"), F.max("UnitPrice").alias("UnitPrice"))


@query
def prj3_missing_columns(spark, folder):
    """What the check names for tables that lack columns, beside the rows of each table."""
    raw, found = retail_lines(spark, folder), []
    for case, gone in (("whole", []), ("no price", ["Price"]), ("no ids", ["Invoice", "Customer ID"])):
        left = cleaning.rename_columns(raw.drop(*gone))
        try:
            cleaning.require_columns(left)
            missing = ""
        except KeyError as error:
            missing = ",".join(c for c in cleaning.REQUIRED if f"'{c}'" in str(error).split(";")[0])
        found.append(left.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(case).alias("Case"), F.lit(missing).alias("Missing"), "Rows"))
    return functools.reduce(DataFrame.unionByName, found)


def dirty_text(spark, folder) -> DataFrame:
    """The raw view as text, with unreadable dates and numbers in known places."""
    raw = retail_lines(spark, folder)
    ends = lambda c, digit: F.col(c).endswith(digit)
    return raw.select(
        "Invoice",
        F.when(~ends("StockCode", "9"), F.col("StockCode")).alias("StockCode"),
        F.when(ends("StockCode", "7"), "many").otherwise(F.col("Quantity").cast("string")).alias("Quantity"),
        F.when(ends("Invoice", "5"), "soon").otherwise(F.col("InvoiceDate").cast("string")).alias("InvoiceDate"),
        F.when(ends("StockCode", "1"), "free").otherwise(F.col("Price").cast("string")).alias("Price"),
        F.col("Customer ID").cast("string").alias("Customer ID"),
        F.when(~ends("Invoice", "8"), F.col("Country")).alias("Country"),
    )


@query
def prj4_lenient_casts(spark, folder):
    lines = cleaning.normalise(dirty_text(spark, folder), CFG)
    return lines.groupBy("Country").agg(
        F.count(F.lit(1)).alias("Rows"),
        F.count("InvoiceDate").alias("Dates"),
        F.max("InvoiceDate").alias("LastDate"),
        F.count("Quantity").alias("Quantities"),
        C.exact_sum(F.col("Quantity")).alias("Units"),
        F.count("UnitPrice").alias("Prices"),
        C.exact_sum(F.col("UnitPrice")).alias("PriceSum"),
        F.count("Revenue").alias("Revenues"),
        F.count("CustomerID").alias("Ids"),
        F.max("CustomerID").alias("LastId"),
    )


@query
def prj5_text_casts(spark, folder):
    lines = cleaning.clean(dirty_text(spark, folder), CFG)
    return lines.groupBy("StockCode").agg(F.count(F.lit(1)).alias("Rows"), F.max("Description").alias("Description"))


@query
def prj9_clean_lines(spark, folder):
    return clean(spark, folder).select(
        "InvoiceNo", "StockCode", "Country", "UnitPrice", "CustomerID", "InvoiceDate", "Quantity", "Revenue",
        "Description", "Year", "Month", "YearMonth", "MonthStart",
    )


@query
def prj10_log_columns(spark, folder):
    return scores.add_log_columns(base(spark, folder).rfm).select("CustomerID", "log_Frequency", "log_Monetary")


@query
def prj10_center_logs(spark, folder):
    """Log columns of the cluster means of the customers."""
    means = transitions.cluster_means(graded_static(base(spark, folder)))
    return scores.add_log_columns(means).select("Cluster", "log_Frequency", "log_Monetary")


@query
def prj11_replace_segment(spark, folder):
    b = base(spark, folder)
    tiers = scores.add_revenue_tier(b.rfm)
    old = b.static_pairs().withColumn("Segment", F.lit("old"))
    return scores.with_segment(old, tiers).select("CustomerID", "StockCode", "Segment")


def _after_rules(n: int) -> Query:
    def run(spark, folder):
        lines = cleaning.normalise(retail_lines(spark, folder), CFG)
        for rule in cleaning.rules(CFG)[:n]:
            lines = lines.where(rule)
        return totals(lines)

    return run


for _n, _name in enumerate(
    ("flt1_drop_missing", "flt2_drop_cancelled", "flt3_positive_only", "flt4_products_only", "flt5_country", "flt6_period"),
    start=1,
):
    _fn = _after_rules(_n)
    _fn.__name__ = _name
    query(_fn)


@query
def flt7_static_year(spark, folder):
    return totals(cleaning.between(clean(spark, folder), CFG.static_start, CFG.static_end))


@query
def flt8_cohort_lines(spark, folder):
    return totals(analysis.prepare_clean(stage(clean(spark, folder)), CFG).dynamic)


@query
def flt9_target_movers(spark, folder):
    rows = drivers.of_grade(moves(spark, folder), CFG.target_grade)
    return rows.where(F.col("MovementType").isin("Up", "Down")).select("CustomerID", "AnalysisMonth", "MovementType")


@query
def aud1_cleaning_audit(spark, folder):
    return cleaning.cleaning_audit(retail_lines(spark, folder), CFG)


@query
def aud2_missing_ids(spark, folder):
    return cleaning.missing_ids(retail_lines(spark, folder), CFG)


@query
def aud3_cancelled_lines(spark, folder):
    return cleaning.cancelled_lines(retail_lines(spark, folder), CFG)


@query
def aud4_duplicate_lines(spark, folder):
    # Two columns repeat often enough for the count to say something.
    lines = clean(spark, folder)
    whole = cleaning.duplicate_lines(lines)
    narrow = cleaning.duplicate_lines(lines.select("StockCode", "Quantity"))
    return whole.withColumn("Columns", F.lit("all")).unionByName(narrow.withColumn("Columns", F.lit("two")))


# --- aggregations ------------------------------------------------------------


@query
def agg1_dataset_summary(spark, folder):
    raw = retail_lines(spark, folder)
    return profile.dataset_summary(raw, stage(cleaning.clean(raw, CFG)))


@query
def agg2_yearly_summary(spark, folder):
    return profile.yearly_summary(stage(clean(spark, folder)))


@query
def agg3_variable_info(spark, folder):
    return profile.variable_info(stage(clean(spark, folder)))


@query
def agg4_rfm(spark, folder):
    lines = cleaning.between(clean(spark, folder), CFG.static_start, CFG.static_end)
    return rfms.create_rfm(lines, CFG.static_end)


@query
def agg4_rfm_latest(spark, folder):
    return rfms.create_rfm(clean(spark, folder), "max")


@query
def agg5_rfm_full_base(spark, folder):
    b = base(spark, folder)
    quarter = cleaning.between(b.static, CFG.static_start, CFG.static_start.replace(month=4))
    rfm = rfms.create_rfm(quarter, CFG.static_start.replace(month=4))
    return rfms.with_idle(rfm, b.rfm, 3)


@query
def agg6_outlier_cut(spark, folder):
    return base(spark, folder).rfm


@query
def agg6_outlier_summary(spark, folder):
    b = base(spark, folder)
    return rfms.outlier_summary(b.rfm_all, b.cutoffs)


@query
def agg7_cluster_summary(spark, folder):
    return transitions.cluster_summary(graded_static(base(spark, folder)))


@query
def agg8_cluster_means(spark, folder):
    return transitions.cluster_means(graded_static(base(spark, folder)))


@query
def agg9_grade_counts(spark, folder):
    return profile.value_counts(graded_static(base(spark, folder)), "Customer_Grade")


@query
def agg9_abc_counts(spark, folder):
    return profile.value_counts(products.analyze_products(base(spark, folder).static_pairs()), "ABC_Class")


@query
def agg9_segment_counts(spark, folder):
    return profile.value_counts(scores.add_scores(base(spark, folder).rfm), "Segment2")


@query
def agg10_product_sales(spark, folder):
    return products.product_sales(base(spark, folder).static_pairs())


@query
def agg11_abc_share(spark, folder):
    return products.abc_revenue_share(products.analyze_products(base(spark, folder).static_pairs()))


@query
def agg12_customer_product(spark, folder):
    return pairs(base(spark, folder))


@query
def agg13_monthly_sales(spark, folder):
    return profile.monthly_sales(clean(spark, folder))


@query
def agg14_order_summary(spark, folder):
    b = base(spark, folder)
    return segments.order_summary_of_months(facts.in_period(b.orders), graded_static(b), "inner")


@query
def agg14_order_summary_all(spark, folder):
    """All orders of the static year, also those of customers without a grade."""
    b = base(spark, folder)
    return segments.order_summary(b.static, graded_static(b), "left")


@query
def agg15_segment_summary(spark, folder):
    b = base(spark, folder)
    return segments.segment_summary(segments.order_summary_of_months(facts.in_period(b.orders), graded_static(b), "inner"))


@query
def agg16_segment_abc_mix(spark, folder):
    b = base(spark, folder)
    return scores.segment_abc_mix(scores.with_segment(pairs(b), scores.add_revenue_tier(b.rfm)))


@query
def agg17_grade_abc_matrix(spark, folder):
    return segments.grade_abc_matrix(pairs(base(spark, folder)))


@query
def agg18_grade_month_revenue(spark, folder):
    b = base(spark, folder)
    return segments.grade_month_revenue(facts.in_period(b.orders), graded_static(b))


@query
def agg19_monthly_grade_counts(spark, folder):
    return transitions.monthly_grade_counts(graded_panel(base(spark, folder)))


@query
def agg20_describe_lines(spark, folder):
    return profile.describe(stage(clean(spark, folder)), ["Revenue", "Quantity", "UnitPrice"], narrow=True)


@query
def agg20_describe_rfm(spark, folder):
    return profile.describe(base(spark, folder).rfm, ["Recency", "Frequency", "Monetary"])


@query
def agg21_correlation(spark, folder):
    return profile.correlation(clean(spark, folder), ["Quantity", "UnitPrice", "Revenue"])


@query
def agg22_vip_summary(spark, folder):
    rfm = base(spark, folder).rfm
    return scores.vip_summary(rfm, scores.vip_threshold(rfm))


@query
def agg23_vip_class_a(spark, folder):
    b = base(spark, folder)
    return scores.vip_class_a_share(pairs(b), scores.vip_threshold(b.rfm))


@query
def agg24_revenue_share_by_grade(spark, folder):
    return transitions.revenue_share_by_grade(graded_panel(base(spark, folder)))


@query
def agg25_cluster_profile(spark, folder):
    b = base(spark, folder)
    return transitions.cluster_profile(
        transitions.cluster_summary(graded_static(b)), transitions.revenue_share_by_grade(graded_panel(b))
    )


# --- ranks, running sums, scores ---------------------------------------------


@query
def win1_running_revenue(spark, folder):
    return products.analyze_products(base(spark, folder).static_pairs())


@query
def win3_long_tail(spark, folder):
    return products.long_tail(products.product_sales(base(spark, folder).static_pairs()))


@query
def win7_scores(spark, folder):
    return scores.add_scores(base(spark, folder).rfm).select("CustomerID", "R_score", "F_score", "M_score")


@query
def win9_rfm_score(spark, folder):
    return scores.add_scores(base(spark, folder).rfm).groupBy("RFM_score").agg(F.count(F.lit(1)).alias("Customers"))


@query
def win10_revenue_tier(spark, folder):
    return scores.add_revenue_tier(base(spark, folder).rfm).select("CustomerID", "Segment")


@query
def win11_rule_segment(spark, folder):
    return scores.add_scores(base(spark, folder).rfm).select("CustomerID", "Segment2")


@query
def lim1_top_products(spark, folder):
    return products.top_products(products.product_sales(base(spark, folder).static_pairs()))


# --- rolling windows ---------------------------------------------------------


@query
def tim1_month_range(spark, folder):
    months = panels.month_range(spark, CFG.panel_first, CFG.panel_last)
    lines = clean(spark, folder).groupBy("MonthStart").agg(F.count(F.lit(1)).alias("Rows"))
    return months.join(lines, F.col("AnalysisMonth") == F.col("MonthStart"), "left").select(
        "AnalysisMonth", F.coalesce("Rows", F.lit(0)).alias("Rows")
    )


@query
def tim3_rolling_panel(spark, folder):
    return analysis.rolling_panel(base(spark, folder))


@query
def tim4_graded_panel(spark, folder):
    return graded_panel(base(spark, folder)).select("CustomerID", "AnalysisMonth", "Cluster", "Customer_Grade")


@query
def tim4_kmeans_panel(spark, folder):
    b = base(spark, folder)
    graded = analysis.graded_panel(stage(analysis.rolling_panel(b)), CFG)
    return graded.select("CustomerID", "AnalysisMonth", "Cluster", "Customer_Grade")


@query
def tim5_snapshot_panel(spark, folder):
    b = base(spark, folder)
    return panels.snapshot_panel(b.months(), CFG.model_first, CFG.model_last, [6], CFG.gap_months)


@query
def tim6_next_purchase_rate(spark, folder):
    return (
        analysis.snapshots(base(spark, folder))
        .groupBy("WindowMonths", "BaseMonthStr")
        .agg(F.count(F.lit(1)).alias("Rows"), F.sum("TargetBuyNextMonth").alias("Buyers"))
    )


@query
def tim7_all_widths(spark, folder):
    return analysis.snapshots(base(spark, folder))


@query
def tim8_rolling_abc(spark, folder):
    return products.rolling_abc(
        base(spark, folder).product_months(), CFG.panel_first, CFG.panel_last, CFG.rolling_months
    )


def _mix(spark, folder):
    b = base(spark, folder)
    bought = stage(b.product_months())
    classes = products.rolling_abc(bought, CFG.panel_first, CFG.panel_last, CFG.rolling_months)
    following = transitions.with_next_grade(graded_panel(b))
    return drivers.mover_mix(following, bought, classes, CFG.target_grade, CFG.rolling_months)


@query
def tim9_mover_mix(spark, folder):
    return _mix(spark, folder)


@query
def tim10_mover_mix_summary(spark, folder):
    return drivers.mover_mix_summary(_mix(spark, folder))


# --- transitions -------------------------------------------------------------


@query
def trn1_next_grade(spark, folder):
    return moves(spark, folder).select("CustomerID", "AnalysisMonth", "Customer_Grade", "NextGrade")


@query
def trn3_movement(spark, folder):
    numbers = (F.col(c).cast("string").alias(c) for c in ("CurrentGradeNum", "NextGradeNum"))
    return moves(spark, folder).select("CustomerID", "AnalysisMonth", *numbers, "MovementType", "Moved")


@query
def trn4_mobility(spark, folder):
    return transitions.mobility_summary(moves(spark, folder))


@query
def trn5_movement_distribution(spark, folder):
    return transitions.distribution(moves(spark, folder), "Customer_Grade")


@query
def trn6_transition_counts(spark, folder):
    return transitions.transition_counts(moves(spark, folder), CFG.target_grade)


@query
def trn6_transition_matrix(spark, folder):
    return transitions.transition_matrix(moves(spark, folder), CFG.target_grade)


@query
def trn7_transition_ratios(spark, folder):
    return transitions.transition_ratios(moves(spark, folder), CFG.target_grade)


# --- models ------------------------------------------------------------------


@query
def ml1_scaling(spark, folder):
    return kmeans.scaling(analysis.rolling_panel(base(spark, folder)), "AnalysisMonth")


@query
def ml2_kmeans_grades(spark, folder):
    b = base(spark, folder)
    fitted = grades.fit_whole(b.rfm, CFG)
    graded = grades.apply_grades(b.rfm, [fitted] if fitted else [], GRADE_NAMES)
    return graded.select("CustomerID", "Cluster", "Customer_Grade")


@query
def ml2_steps_from_given_centers(spark, folder):
    """Four steps from fixed centers, so that SQL can follow them."""
    rfm = base(spark, folder).rfm.withColumn("all", F.lit(0))
    models = kmeans.from_centers(rfm, "all", fixed.CENTERS, 4)
    return grades.apply_grades(rfm, models, GRADE_NAMES, "all").select("CustomerID", "Cluster", "Customer_Grade")


@query
def tim4_steps_from_given_centers(spark, folder):
    """The same for every month of the panel, each with its own scaling."""
    panel = stage(analysis.rolling_panel(base(spark, folder)))
    models = kmeans.from_centers(panel, "AnalysisMonth", fixed.CENTERS, 3)
    graded = grades.apply_grades(panel, models, GRADE_NAMES, "AnalysisMonth")
    return graded.select("AnalysisMonthStr", "CustomerID", "Cluster", "Customer_Grade")


@query
def ml3_nearest_center(spark, folder):
    return graded_static(base(spark, folder)).select("CustomerID", "Cluster")


@query
def ml4_centers(spark, folder):
    # Means of the rows at each center, next to the center itself.
    b = base(spark, folder)
    near = kmeans.assign(b.rfm, None, [fixed.model()])
    centers = grades.centers_table(spark, [fixed.model()], GRADE_NAMES)
    return (
        near.groupBy("Cluster").agg(F.count(F.lit(1)).alias("Customers"))
        .join(centers.drop("Grouping"), "Cluster")
    )


@query
def ml5_grade_naming(spark, folder):
    return graded_static(base(spark, folder)).select("CustomerID", "Cluster", "Customer_Grade")


@query
def ml6_k_sweep(spark, folder):
    return grades.evaluate_k(base(spark, folder).rfm, CFG)


@query
def ml6_steps_from_given_starts(spark, folder):
    """Three steps for every k from starts spread evenly over the range of the customers."""
    rfm = base(spark, folder).rfm
    each = rfm.withColumn("K", F.explode(F.array(*map(F.lit, CFG.k_values))))
    models = kmeans.from_centers(each, "K", {k: fixed.starts(k) for k in CFG.k_values}, 3)
    axes = [f"_x{i}" for i in range(len(FEATURES))]
    placed = stage(kmeans.assign(each, "K", models).withColumn("K", F.col("K").cast("int")).select("K", *axes, "Cluster"))
    inertia = kmeans.small_table(rfm, {"K": [m.k for m in models], "Inertia": [m.cost for m in models]})
    return inertia.join(silhouette.squared(placed, axes), "K")


def _assigned(spark, folder) -> DataFrame:
    near = kmeans.assign(base(spark, folder).rfm, None, [fixed.model()])
    return stage(near.select(F.lit(5).alias("K"), "_x0", "_x1", "_x2", "Cluster"))


@query
def ml7_silhouette(spark, folder):
    return silhouette.euclidean_exact(_assigned(spark, folder), ["_x0", "_x1", "_x2"])


@query
def ml7_silhouette_cells(spark, folder):
    return silhouette.euclidean(_assigned(spark, folder), ["_x0", "_x1", "_x2"])


@query
def ml7_silhouette_squared(spark, folder):
    return silhouette.squared(_assigned(spark, folder), ["_x0", "_x1", "_x2"])


@query
def ml8_time_split(spark, folder):
    train, test = predict.split_by_time(analysis.snapshots(base(spark, folder)), CFG.train_end)
    size = lambda df, side: df.groupBy("WindowMonths").agg(
        F.count(F.lit(1)).alias("Rows"), F.sum("TargetBuyNextMonth").alias("Buyers")
    ).withColumn("Side", F.lit(side))
    return size(train, "train").unionByName(size(test, "test"))


@query
def ml9_scored_test(spark, folder):
    panel = stage(analysis.snapshots(base(spark, folder)))
    fits = predict.fit_windows(panel, CFG.model_windows, CFG.train_end)
    scored = predict.score_windows(panel, fits, CFG.train_end)
    return scored.select("CustomerID", "BaseMonth", "WindowMonths", "TargetBuyNextMonth", "PredProb")


@query
def ml10_auc(spark, folder):
    # A fixed score: customers seen recently come first. Recency has many ties.
    _, test = predict.split_by_time(analysis.snapshots(base(spark, folder)), CFG.train_end)
    scored = test.withColumn("PredProb", -F.col("Recency"))
    return predict.auc(scored, ["WindowMonths", "BaseMonthStr"])


@query
def ml11_degenerate_splits(spark, folder):
    """Summaries where no test rows are left, and where every customer buys: no model, but counts."""
    panel = stage(analysis.snapshots(base(spark, folder)))
    late = predict.evaluate_windows(panel, CFG.model_windows, CFG.end).summary
    buyers = panel.withColumn("TargetBuyNextMonth", F.lit(1))
    same = predict.evaluate_windows(buyers, CFG.model_windows, CFG.train_end).summary
    return late.withColumn("Case", F.lit("no test rows")).unionByName(same.withColumn("Case", F.lit("one class")))


@query
def ml12_auc_summary(spark, folder):
    return predict.evaluate_windows(
        analysis.snapshots(base(spark, folder)), CFG.model_windows, CFG.train_end
    ).summary


@query
def ml12_monthly_auc(spark, folder):
    return predict.evaluate_windows(
        analysis.snapshots(base(spark, folder)), CFG.model_windows, CFG.train_end
    ).monthly


# --- drivers -----------------------------------------------------------------


@query
def drv1_median_split(spark, folder):
    rows = target_rows(spark, folder)
    return drivers.impact_rows(rows).groupBy("Variable", "Group").agg(
        F.count(F.lit(1)).alias("Rows"), F.max("Cut").alias("Cut")
    )


@query
def drv2_impact_summary(spark, folder):
    return drivers.impact_summary(drivers.impact_rows(target_rows(spark, folder)))


@query
def drv3_impact_distribution(spark, folder):
    return drivers.impact_distribution(drivers.impact_rows(target_rows(spark, folder)))


@query
def drv5_high_monetary(spark, folder):
    return drivers.high_monetary_summary(drivers.high_monetary(target_rows(spark, folder)))


@query
def drv5_high_monetary_distribution(spark, folder):
    split = drivers.high_monetary(target_rows(spark, folder))
    return transitions.distribution(split, "FreqGroup_in_HighM")


@query
def drv6_repeat_summary(spark, folder):
    return drivers.repeat_summary(drivers.with_repeat_status(drivers.of_grade(moves(spark, folder), CFG.target_grade)))


@query
def drv6_repeat_distribution(spark, folder):
    rows = drivers.with_repeat_status(drivers.of_grade(moves(spark, folder), CFG.target_grade))
    return transitions.distribution(rows, "RepeatStatus")


@query
def snk2_report_sizes(spark, folder):
    """Writes the small reports that need no model and reads their sizes back."""
    raw = retail_lines(spark, folder)
    lines = cleaning.clean(raw, CFG)
    tables = {
        "preprocessing_stats": cleaning.cleaning_audit(raw, CFG),
        "yearly_summary": profile.yearly_summary(lines),
        "monthly_sales": profile.monthly_sales(lines),
        "nothing": profile.yearly_summary(lines).where(F.lit(False)),
    }
    target = _scratch(spark, "report")
    out = None
    for name in sinks.save_reports(tables, target):
        size = (
            spark.read.option("header", True).csv(os.path.join(target, name))
            .agg(F.count(F.lit(1)).alias("Rows")).withColumn("Table", F.lit(name))
        )
        out = size if out is None else out.unionByName(size)
    return out


def _results(spark, folder) -> dict[str, DataFrame]:
    # The run reads the raw lines three times: the view's joins are made once.
    return analysis.run(stage(retail_lines(spark, folder)), CFG, fixed.model())


def _cells(name: str, table: DataFrame) -> DataFrame:
    """Per column of a table: cells that are not null, the sum of the numbers, first and last of the other texts."""
    named = [F.struct(F.lit(c).alias("Column"), F.col(f"`{c}`").cast("string").alias("_v")) for c in table.columns]
    cells = table.select(F.explode(F.array(*named)).alias("_e")).select("_e.*").where("_v is not null")
    number = F.col("_v").try_cast("double")
    text = F.when(number.isNull(), F.col("_v"))
    return cells.groupBy("Column").agg(
        F.count(F.lit(1)).alias("Cells"), F.round(F.sum(number), 3).alias("Total"), F.min(text).alias("First"), F.max(text).alias("Last")
    ).withColumn("Table", F.lit(name))


@query
def snk2_report(spark, folder):
    """Writes the whole report with a broken run after it, and reads back what all tables hold."""
    target = _scratch(spark, "report")
    tables = analysis.report_tables(_results(spark, folder))
    tables["nothing"] = tables["yearly_summary"].where(F.lit(False))
    sinks.save_reports(tables, target)
    broken = {"yearly_summary": tables["yearly_summary"], "broken": tables["yearly_summary"].select(F.raise_error(F.lit("stop")).cast("string").alias("x"))}
    try:
        sinks.save_reports(broken, target)
    except Exception:
        pass  # the report before must still be there
    return functools.reduce(DataFrame.unionByName, (_cells(n, tidy(t)) for n, t in sinks.read_reports(spark, target).items()))


@query
def snk3_result_set(spark, folder):
    """Names and columns of all results, beside the clean rows they come from."""
    results = _results(spark, folder)
    rows = results["df_clean"].agg(F.count(F.lit(1)).alias("CleanRows"))
    named = [F.struct(F.lit(n).alias("Result"), F.lit(",".join(sorted(t.columns))).alias("Columns")) for n, t in results.items()]
    return rows.select(F.explode(F.array(*named)).alias("_e"), "CleanRows").select("_e.*", "CleanRows")
