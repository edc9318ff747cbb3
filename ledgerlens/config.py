"""Run parameters. Every operator takes what it needs from here as plain values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

# Stock codes that are charges or adjustments, not products.
NON_PRODUCT_CODES = ("POST", "D", "M", "BANK CHARGES", "DOT", "C2")

# Customer grades, lowest first.
GRADE_NAMES = (
    "Lv1.이탈관리",
    "Lv2.관심필요",
    "Lv3.신규성장",
    "Lv4.우수충성",
    "Lv5.최우수VIP",
)

# Label of a customer-month that has no following month in the panel.
NO_ACTIVITY = "NoActivity"

FEATURES = ("Recency", "Frequency", "Monetary")


@dataclass(frozen=True)
class RetailConfig:
    # Defaults that the results depend on.
    country: str = "United Kingdom"
    start: date = date(2010, 1, 1)
    end: date = date(2012, 1, 1)
    static_start: date = date(2011, 1, 1)
    static_end: date = date(2012, 1, 1)
    non_product_codes: tuple[str, ...] = NON_PRODUCT_CODES
    grade_names: tuple[str, ...] = GRADE_NAMES
    target_grade: str = GRADE_NAMES[2]
    final_k: int = 5
    k_values: tuple[int, ...] = tuple(range(2, 11))
    n_init: int = 10
    seed: int = 42
    max_iter: int = 300
    tol: float = 1e-4
    panel_first: date = date(2011, 1, 1)
    panel_last: date = date(2011, 12, 1)
    rolling_months: int = 6
    model_first: date = date(2011, 1, 1)
    model_last: date = date(2011, 10, 1)
    model_windows: tuple[int, ...] = (3, 6, 12)
    train_end: date = date(2011, 7, 1)
    # Months between the snapshot month and the month whose purchases are the target.
    gap_months: int = 1
    outlier_quantile: float = 0.99
    # Date that static recency counts from: none for static_end, else a date, 'max' or 'max+1d'.
    snapshot: date | str | None = None
    # Drop rows whose stock code is null instead of keeping them as the text 'nan'.
    strict_nulls: bool = False
    # Leave the last panel month out of the transition reports (it has no next month).
    exclude_censored: bool = False
    # Extra text patterns tried for InvoiceDate after ISO text.
    date_formats: tuple[str, ...] = ()

    def shifted(self, years: int) -> "RetailConfig":
        """The same run with every date moved by whole years."""
        names = (
            "start", "end", "static_start", "static_end", "panel_first",
            "panel_last", "model_first", "model_last", "train_end",
        )
        return replace(self, **{n: _years_on(getattr(self, n), years) for n in names})


def _years_on(day: date, years: int) -> date:
    """The same day of another year; 29 February becomes the 28th where there is none."""
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)
