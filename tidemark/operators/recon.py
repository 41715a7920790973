"""Reconciliation between layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(frames: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Rows per (layer, table), one line each.

    A count over stored Parquet needs the footers only.
    """
    lines = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), "n_rows"
        )
        for (layer, table), df in frames.items()
    ]
    return reduce(DataFrame.unionByName, lines)


def lookup_key(df: DataFrame, column: str, value, columns: list[str]) -> DataFrame:
    """Rows of one key; the equality reaches the Parquet scan."""
    return df.filter(F.col(column) == F.lit(value)).select(*columns)


def sample(df: DataFrame, order: str, columns: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by a key, so that the sample is the same every time."""
    return df.orderBy(order).limit(n).select(*columns)
