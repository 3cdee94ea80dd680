"""Calendar columns: weekday (Monday = 0), season, day parts, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (month, day, name) of the recurring holidays.
HOLIDAYS = (
    (1, 1, "New Year"),
    (2, 14, "Valentine"),
    (5, 1, "Labour Day"),
    (7, 4, "Summer Day"),
    (10, 31, "Halloween"),
    (11, 11, "Singles Day"),
    (12, 25, "Christmas"),
    (12, 31, "New Year Eve"),
)


def holiday_name(d: Column) -> Column:
    """Holiday name of a date, NULL on ordinary days."""
    out = None
    for m, day, name in HOLIDAYS:
        hit = (F.month(d) == m) & (F.dayofmonth(d) == day)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def is_holiday(d: Column) -> Column:
    """Whether a date is one of the recurring holidays: one membership test on month and day."""
    return (F.month(d) * 100 + F.dayofmonth(d)).isin([m * 100 + day for m, day, _ in HOLIDAYS])


def weekday(d: Column) -> Column:
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def season(d: Column, fall: str = "autumn") -> Column:
    m = F.month(d)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise(fall)
    )


def calendar_columns(df: DataFrame, day: str = "sale_date", month_end_from: int = 25) -> DataFrame:
    """Day-of-week, month, quarter, day, ISO week, day-of-year, weekend, month start and end flags."""
    d = F.col(day)
    return df.withColumns(
        {
            "day_of_week": F.weekday(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "day_of_month": F.dayofmonth(d),
            "iso_week": F.weekofyear(d),
            "day_of_year": F.dayofyear(d),
            "is_weekend": (F.weekday(d) >= 5).cast("int"),
            "is_month_start": (F.dayofmonth(d) <= 5).cast("int"),
            "is_month_end": (F.dayofmonth(d) >= month_end_from).cast("int"),
        }
    )


def cyclic_columns(df: DataFrame, day: str = "sale_date") -> DataFrame:
    """Sine and cosine of day-of-year, ISO week and month."""
    d = F.col(day)
    phases = {
        "day": F.dayofyear(d) / F.lit(365.25),
        "week": F.weekofyear(d) / F.lit(52.0),
        "month": F.month(d) / F.lit(12.0),
    }
    cols = {}
    for name, phase in phases.items():
        cols[f"{name}_sin"] = F.sin(phase * (2 * math.pi))
        cols[f"{name}_cos"] = F.cos(phase * (2 * math.pi))
    return df.withColumns(cols)
