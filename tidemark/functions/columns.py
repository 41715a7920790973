"""Normalisers.  All stay inside Catalyst, so they join whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    return F.trim(c)


def lowered(c: Column) -> Column:
    return F.lower(F.trim(c))


def uppered(c: Column) -> Column:
    return F.upper(F.trim(c))


def replaced(c: Column, mapping: dict[str, str]) -> Column:
    """Swap the listed values, leave every other value alone."""
    for old, new in mapping.items():
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def tolerant(c: Column, kind: str, most: float = 1e16) -> Column:
    """Cast where text that does not parse becomes NULL, also in ANSI mode.

    NaN and the infinities have no decimal form, and the warehouse's
    ``decimal(18,2)`` holds less than 10**16, so a double that is not within
    these bounds counts as missing: rules on required columns then reject the
    row, and one bad value never stops the load of a table.
    """
    value = c.try_cast(kind)
    if kind == "double":
        return F.when(F.abs(value) < F.lit(most), value)
    return value


def strict(c: Column, source_kind: str, kind: str) -> Column:
    """ANSI cast for the warehouse load: a bad value fails the load.

    Fractions are rounded, not cut, when a double becomes an integer.
    """
    if source_kind == "double" and kind == "int":
        c = F.round(c)
    return c.cast(kind)


def date_key(c: Column) -> Column:
    """``yyyyMMdd`` as an integer, by arithmetic instead of text formatting."""
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def month_key(c: Column) -> Column:
    """``yyyyMM`` as an integer; 0 stands for an unknown date."""
    return F.coalesce(F.year(c) * 100 + F.month(c), F.lit(0))
