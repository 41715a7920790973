"""Data checks.  Each gives the failing rows or keys; empty means passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of NULLs, from a single aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns]
    return counts.select(F.inline(F.array(*pairs)))


def unexpected_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Non-NULL values outside the list, with their number of rows."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return bad.groupBy(column).agg(F.count("*").alias("n_rows"))


def failing(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def verdict(failures: str, severity: str) -> Column:
    """``pass``, or the severity of the check if something failed."""
    return F.when(F.col(failures) == 0, F.lit("pass")).otherwise(F.col(severity))
