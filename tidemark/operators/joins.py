"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import first_rows_per_key


def key_counts(df: DataFrame, key: str, count: str = "n_rows") -> DataFrame:
    """Rows per non-NULL key; a hot key shrinks to one row per map task."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count))


def match_count(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``COUNT(*)`` of the inner join, without building the joined rows.

    Both sides are counted per key first; a key pair contributes the product.
    """
    a = key_counts(left, left_key, "n_left").withColumnRenamed(left_key, "_key")
    b = key_counts(right, right_key, "n_right").withColumnRenamed(right_key, "_key")
    product = F.col("n_left") * F.col("n_right")
    return a.join(b, "_key").agg(F.coalesce(F.sum(product), F.lit(0)).alias("matching_rows"))


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-NULL child keys that the parent lacks, with their number of rows.

    Both sides meet in one grouping, after each task has counted its own.  As a
    join, the parent's keys were broadcast whenever their columns were small on
    disk, and held by the driver at many times that size.
    """
    rows = child.select(key, F.lit(False).alias("_known"))
    known = parent.select(F.col(parent_key).alias(key), F.lit(True).alias("_known"))
    met = rows.union(known).filter(F.col(key).isNotNull()).groupBy(key)
    counted = met.agg(F.count_if(~F.col("_known")).alias("n_rows"), F.max("_known").alias("_known"))
    return counted.filter(~F.col("_known")).drop("_known")


def first_orphans(
    child: DataFrame, key: str, parent: DataFrame, parent_key: str, order: str, n: int
) -> DataFrame:
    """The ``n`` first child rows, by ``order``, without a parent.

    The first ``n`` overall are among the first ``n`` of their own key, so each
    key is cut to ``n`` rows before the join.  NULL keys are orphans too.
    """
    few = first_rows_per_key(child.select(order, key), [key], [order], n)
    known = parent.select(F.col(parent_key).alias(key))
    return few.join(known, key, "left_anti").orderBy(order, key).limit(n).select(order, key)
