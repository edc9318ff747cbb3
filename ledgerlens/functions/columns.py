"""Column expressions. All of them stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, functions as F

from ledgerlens.config import GRADE_NAMES, NO_ACTIVITY

# Exact money sums: 30 digits before the point, so neither lines nor totals of totals overflow.
MONEY = "decimal(38,8)"

# Text that a cast may take for a whole number, with the white space and control characters it leaves out.
_WHOLE = r"^[\s\p{Cntrl}]*[+-]?[0-9]+[\s\p{Cntrl}]*$"


def instant(value: date | datetime) -> Column:
    """Literal timestamp without time zone."""
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")


def day(value: date) -> Column:
    return F.expr(f"date'{value:%Y-%m-%d}'")


def as_number(name: str) -> Column:
    """Number or null; NaN counts as missing (Spark orders NaN above every number)."""
    parsed = F.expr(f"try_cast(`{name}` as double)")
    return F.when(~F.isnan(parsed), parsed)


def as_instant(name: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp or null; `formats` are tried after ISO text."""
    tries = [F.expr(f"try_cast(`{name}` as timestamp_ntz)")]
    for fmt in formats:
        tries.append(F.try_to_timestamp(F.col(f"`{name}`").cast("string"), F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def as_text(name: str) -> Column:
    """Text cast that happens before null handling: a missing value becomes the text 'nan'."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan"))


def as_id(name: str, floating: bool = False) -> Column:
    """17850.0 -> '17850', as is 17850.5; text that is a whole number keeps all its digits. What is no number, or
    is beyond 64 bits, is missing. Set `floating` for float or double columns: their text always has a point, so
    none is made."""
    if floating:
        return F.expr(f"try_cast(try_cast(`{name}` as double) as bigint)").cast("string")
    text, parsed = F.col(f"`{name}`").cast("string"), F.expr(f"try_cast(cast(`{name}` as string) as bigint)")
    # Only text that can be a whole number is read as one: a failed cast raises an exception for each row inside Spark.
    whole = F.coalesce(F.when(text.rlike(_WHOLE), parsed), F.expr(f"try_cast(try_cast(`{name}` as double) as bigint)"))
    return F.when(as_number(name).isNotNull(), whole.cast("string"))


def exact_sum(value: Column) -> Column:
    """Sum in decimals: the same result in any row order, 0 when nothing is there."""
    return F.when(F.count(value) > 0, F.sum(value.cast(MONEY)).cast("double")).otherwise(0.0)


def exact_mean(value: Column) -> Column:
    """Mean over non-null values through an exact sum."""
    total = F.sum(value.cast(MONEY)).cast("double")
    return total / F.nullif(F.count(value), F.lit(0))


def rate(condition: Column) -> Column:
    """Share of rows for which `condition` holds (null counts as not)."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def whole_days(earlier: Column, later: Column) -> Column:
    """Full 24-hour days from `earlier` to `later`, rounded down, also below zero."""
    gap = later - earlier
    days = F.date_part(F.lit("DAY"), gap).cast("int")
    return days - F.when(gap < F.make_dt_interval(days), 1).otherwise(0)


def recency_months(last: Column, snapshot: Column) -> Column:
    return F.round(whole_days(last, snapshot) / F.lit(30.0), 1)


def month_of(value: Column) -> Column:
    return F.trunc(value, "month")


def month_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def abc_class(ratio: Column) -> Column:
    return F.when(ratio <= 0.80, "A").when(ratio <= 0.95, "B").otherwise("C")


def grade_number(grade: Column, names: Sequence[str] = GRADE_NAMES) -> Column:
    """1..k for a known grade label, null for any other text."""
    number = F.when(grade == names[0], 1)
    for position, name in enumerate(names[1:], start=2):
        number = number.when(grade == name, position)
    return number


def grade_order(grade: Column) -> Column:
    """The digit after 'Lv', null when there is none."""
    return F.nullif(F.regexp_extract(grade, r"Lv(\d)", 1), F.lit("")).cast("int")


def movement(current: Column, following: Column, following_label: Column) -> Column:
    """Direction between two grade numbers."""
    return (
        F.when(following_label == NO_ACTIVITY, NO_ACTIVITY)
        .when(current.isNull() | following.isNull(), "Unknown")
        .when(following > current, "Up")
        .when(following < current, "Down")
        .otherwise("Stay")
    )
