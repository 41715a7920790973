"""Split a frame into valid and rejected rows and account for both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import Rule, broken, first_reason, met
from tidemark.schemas import REASON


def valid_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.filter(met(rules))


def rejected_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that fail a rule, with the reason of the first one they fail."""
    return df.filter(broken(rules)).withColumn(REASON, first_reason(rules))


def cleaning_metrics(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """The five row counts of a cleaning run, from one pass over ``df``.

    Silver has one row per valid key, so its size is the exact distinct count
    of valid keys; no window is needed to know it.  Rows collapse to one per
    key and task before the shuffle.
    """
    bad = broken(rules)
    per_key = (
        df.select(*keys, bad.alias("_bad"))
        .groupBy("_bad", *[F.when(~F.col("_bad"), F.col(k)).alias(k) for k in keys])
        .agg(F.count("*").alias("_n"))
    )
    n_valid = F.sum(F.when(~F.col("_bad"), F.col("_n")).otherwise(0))
    n_silver = F.count_if(~F.col("_bad"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("bronze_rows"),
        F.coalesce(n_valid, F.lit(0)).alias("valid_rows"),
        F.coalesce(n_valid - n_silver, F.lit(0)).alias("duplicates_removed"),
        F.coalesce(F.sum("_n") - n_valid, F.lit(0)).alias("rejected_rows"),
        n_silver.alias("silver_rows"),
    )
