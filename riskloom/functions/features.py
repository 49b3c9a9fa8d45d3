"""Row-level feature expressions used by the batch build and by request scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(ts: Column) -> Column:
    """Microseconds since the epoch: the integer time axis of every window."""
    return F.unix_micros(ts.cast("timestamp"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with a zero or missing denominator giving NULL."""
    return num / F.nullif(den, F.lit(0.0))


def calendar(ts: Column) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": day,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_night": (hour < 6).cast("int"),
        "is_weekend": (day >= 5).cast("int"),
    }


def amounts(amount: Column) -> dict[str, Column]:
    size = F.abs(amount)
    return {
        "abs_amount": size,
        "log_amount": F.log1p(size),
        "is_refund": (amount < 0).cast("int"),
    }


def card_age_years(ts: Column, opened: Column) -> Column:
    """Whole days since an ``MM/yyyy`` month start, in years; an unreadable month is NULL."""
    start = F.try_to_timestamp(opened, F.lit("MM/yyyy"))
    return F.datediff(ts, start) / F.lit(365.25)


def years_since_pin_change(ts: Column, changed: Column) -> Column:
    return (F.year(ts) - changed.try_cast("int")).cast("double")


def ratios(size: Column, limit: Column, income: Column, debt: Column) -> dict[str, Column]:
    return {
        "amount_to_credit_limit": safe_ratio(size, limit),
        "amount_to_income": safe_ratio(size, income),
        "debt_to_income": safe_ratio(debt, income),
    }
