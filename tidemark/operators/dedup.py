"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Keep the row with the highest ``newest`` columns of every key.

    Ties are decided by all remaining columns, so the result depends on the
    data only, not on the order in which tasks finish.  Written as
    ``row_number() = 1``: Spark then limits each key inside every map task
    before the shuffle, so a key with many copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in newest]
    order = [F.col(c).desc_nulls_last() for c in newest]
    order += [F.col(c).asc_nulls_last() for c in rest]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(f"{_RANK} = 1").drop(_RANK)


def first_rows_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """The ``n`` first rows of every key; limited before the shuffle as above."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(f"{_RANK} <= {n}").drop(_RANK)


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "record_count") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) > 1)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key occurs twice.  Runs a job; fetches one row at most."""
    sample = duplicate_keys(df, keys).take(1)
    if sample:
        raise ValueError(f"{what}: key {sample[0].asDict()} is not unique")
