"""Calendar parts of a date column, in the order of the date dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import date_key

ISO_WEEKEND = (6, 7)


def iso_weekday(day: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(day) + 1


def calendar_columns(day: Column) -> dict[str, Column]:
    return {
        "date_key": date_key(day),
        "date_day": day,
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.monthname(day),
        "week_of_year": F.weekofyear(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": iso_weekday(day),
        "day_name": F.dayname(day),
        "is_weekend": iso_weekday(day).isin(*ISO_WEEKEND),
    }
