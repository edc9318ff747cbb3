"""The whole analysis: clean lines in, named result tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerlens.config import RetailConfig
from ledgerlens.operators import clean as cleaning
from ledgerlens.operators import drivers, facts, grades, panel as panels, predict, products, profile, rfm as rfms
from ledgerlens.operators import scores, segments, transitions
from ledgerlens.operators.kmeans import ClusterModel
from ledgerlens.session import stage


@dataclass
class Base:
    """Tables that most reports start from."""

    clean: DataFrame
    static: DataFrame
    orders: DataFrame
    rfm_all: DataFrame
    cutoffs: tuple
    rfm: DataFrame
    config: RetailConfig

    @property
    def static_filtered(self) -> DataFrame:
        return rfms.lines_of_customers(self.static, self.rfm)

    @property
    def dynamic(self) -> DataFrame:
        """All lines of the kept customers, also those outside the static year."""
        return rfms.lines_of_customers(self.clean, self.rfm)

    # The tables below filter by customer only after their aggregation: the join
    # then sees a few rows per customer, also for one that owns a third of the lines.

    def months(self) -> DataFrame:
        """Customer-months of the kept customers."""
        widest = max(self.config.rolling_months, *self.config.model_windows)
        return rfms.of_customers(facts.customer_months(self.orders, widest), self.rfm)

    def product_months(self) -> DataFrame:
        """Customer-product-months of the kept customers."""
        period = (self.config.static_start, self.config.static_end)
        return rfms.of_customers(facts.product_months(self.clean, period), self.rfm)

    def static_pairs(self) -> DataFrame:
        """Static-year quantity and revenue per kept customer and product."""
        return rfms.of_customers(products.customer_product(self.static), self.rfm)


def prepare(raw: DataFrame, config: RetailConfig) -> Base:
    """Clean lines, their orders, static-year rfm and the customers left after the outlier cut.

    The orders are staged: static rfm and all rolling windows come from them,
    so the lines are read once for everything that is about customers.
    """
    lines = cleaning.clean(raw, config)
    return prepare_clean(lines, config)


def prepare_clean(lines: DataFrame, config: RetailConfig) -> Base:
    static = cleaning.between(lines, config.static_start, config.static_end)
    orders = stage(facts.order_months(lines, (config.static_start, config.static_end)))
    rfm_all = stage(rfms.rfm_of_orders(facts.in_period(orders), config.snapshot or config.static_end))
    cutoffs = rfms.outlier_cutoffs(rfm_all, config.outlier_quantile)
    return Base(lines, static, orders, rfm_all, cutoffs, rfms.drop_outliers(rfm_all, cutoffs), config)


def rolling_panel(base: Base, months: DataFrame | None = None) -> DataFrame:
    c = base.config
    months = base.months() if months is None else months
    return panels.rolling_rfm(months, base.rfm, c.panel_first, c.panel_last, c.rolling_months)


def graded_panel(panel: DataFrame, config: RetailConfig) -> DataFrame:
    """`panel` is read several times; stage it first."""
    models = grades.fit_months(panel, config)
    return grades.apply_grades(panel, models, config.grade_names, "AnalysisMonth")


def snapshots(base: Base, months: DataFrame | None = None) -> DataFrame:
    c = base.config
    months = base.months() if months is None else months
    return panels.snapshot_panel(months, c.model_first, c.model_last, c.model_windows, c.gap_months)


def run(raw: DataFrame, config: RetailConfig, model: ClusterModel | None = None) -> dict[str, DataFrame]:
    """Every result table by name. Shared tables are staged once, reports stay lazy.

    A known `model` grades all customers and months in place of the fits; the sweep over k is then left out.
    """
    lines = stage(cleaning.clean(raw, config))
    base = prepare_clean(lines, config)
    out: dict[str, DataFrame] = {
        "dataset_summary": profile.dataset_summary(raw, lines),
        "preprocessing_stats": cleaning.cleaning_audit(raw, config),
        "yearly_summary": profile.yearly_summary(lines),
        "variable_info": profile.variable_info(lines),
        "monthly_sales": profile.monthly_sales(lines),
        "describe_lines": profile.describe(lines, ["Revenue", "Quantity", "UnitPrice"], narrow=True),
        "describe_rfm": profile.describe(base.rfm, ["Recency", "Frequency", "Monetary"]),
        "correlation": profile.correlation(lines, ["Quantity", "UnitPrice", "Revenue"]),
        "outlier_summary": rfms.outlier_summary(base.rfm_all, base.cutoffs),
        "df_clean": lines,
        "df_static_filtered": base.static_filtered,
        "df_dynamic": base.dynamic,
        "rfm_static": base.rfm,
    }
    if model is None:
        out["k_evaluation"] = grades.evaluate_k(base.rfm, config)
    static_model = model or grades.fit_whole(base.rfm, config)
    segmented = grades.apply_grades(base.rfm, [static_model] if static_model else [], config.grade_names)
    out["rfm_segmented"] = segmented
    out["cluster_summary"] = transitions.cluster_summary(segmented)

    product_months = stage(base.product_months())
    static_products = product_months.where(F.col("PeriodLines") > 0).select(
        "CustomerID", "StockCode", F.col("PeriodUnits").alias("Quantity"), F.col("PeriodMoney").alias("Revenue")
    )
    out["product_sales"] = stage(products.analyze_products(static_products))
    out["top_products"] = products.top_products(out["product_sales"])
    out["product_rank"] = products.long_tail(out["product_sales"])
    out["abc_revenue_share"] = products.abc_revenue_share(out["product_sales"])
    pairs = products.integrate(products.customer_product(static_products), segmented, out["product_sales"])
    tiers = scores.add_revenue_tier(base.rfm)
    out["customer_product"] = scores.with_segment(pairs, tiers)
    out["segment_abc"] = scores.segment_abc_mix(out["customer_product"])
    out["rfm_scored"] = scores.add_scores(base.rfm)
    out["rule_segment_counts"] = profile.value_counts(out["rfm_scored"], "Segment2")
    threshold = scores.vip_threshold(base.rfm)
    out["vip_summary"] = scores.vip_summary(base.rfm, threshold)
    out["vip_class_a"] = scores.vip_class_a_share(pairs, threshold)
    static_orders = facts.in_period(base.orders)
    orders = segments.order_summary_of_months(static_orders, segmented, "inner")
    out["order_summary"] = orders
    out["segment_summary"] = segments.segment_summary(orders)
    out["segment_abc_ratio"] = segments.grade_abc_matrix(pairs)
    out["grade_month_revenue"] = segments.grade_month_revenue(static_orders, segmented)

    months = stage(base.months())
    rolling = stage(rolling_panel(base, months))
    panel = stage(grades.apply_grades(rolling, [model], config.grade_names) if model else graded_panel(rolling, config))
    out["monthly_panel"] = panel
    out["monthly_grade_counts"] = transitions.monthly_grade_counts(panel, config.grade_names)

    report = predict.evaluate_windows(snapshots(base, months), config.model_windows, config.train_end)
    out["auc_summary"], out["monthly_auc"], out["scored_test"] = report.summary, report.monthly, report.scored

    moves = stage(transitions.with_next_grade(panel, config.exclude_censored))
    out["transition_base"] = moves
    out["mobility_summary"] = transitions.mobility_summary(moves)
    out["movement_dist"] = transitions.distribution(moves, "Customer_Grade")
    out["lv3_next_month_count"] = transitions.transition_counts(moves, config.target_grade)
    out["lv3_next_month_ratio"] = transitions.transition_ratios(moves, config.target_grade)
    shares = transitions.revenue_share_by_grade(panel)
    out["cluster_profile"] = transitions.cluster_profile(out["cluster_summary"], shares)

    classes = products.rolling_abc(product_months, config.panel_first, config.panel_last, config.rolling_months)
    mix = drivers.mover_mix(moves, product_months, classes, config.target_grade, config.rolling_months)
    out["lv3_abc_detail"] = mix
    out["lv3_abc_summary"] = drivers.mover_mix_summary(mix)

    target = drivers.of_grade(moves, config.target_grade)
    melted = drivers.impact_rows(target)
    out["rfm_impact_summary"] = drivers.impact_summary(melted)
    out["rfm_impact_dist"] = drivers.impact_distribution(melted)
    split = drivers.high_monetary(target)
    out["high_m_freq_summary"] = drivers.high_monetary_summary(split)
    out["high_m_freq_dist"] = transitions.distribution(split, "FreqGroup_in_HighM")
    repeat = drivers.with_repeat_status(target)
    out["repeat_summary"] = drivers.repeat_summary(repeat)
    out["repeat_dist"] = transitions.distribution(repeat, "RepeatStatus")
    return out


# The tables of the written report, in order.
REPORT = (
    "dataset_summary",
    "preprocessing_stats",
    "yearly_summary",
    "variable_info",
    "outlier_summary",
    "cluster_summary",
    "auc_summary",
    "monthly_auc",
    "mobility_summary",
    "movement_dist",
    "lv3_next_month_ratio",
    "lv3_abc_summary",
    "high_m_freq_summary",
    "repeat_summary",
    "repeat_dist",
)


def report_tables(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: results[name] for name in REPORT}
