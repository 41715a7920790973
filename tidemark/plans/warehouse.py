"""Silver to RAW: the typed load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import strict
from tidemark.schemas import BATCH_COLUMNS, PROCESSED_AT, RAW, SILVER


def to_raw(silver: DataFrame, table: str) -> DataFrame:
    """Exact types by column name; a value that does not fit fails the load."""
    source = SILVER[table]
    business = [
        strict(F.col(name), source[name], kind).alias(name) for name, kind in RAW[table].items()
    ]
    batch = [F.col(name).cast(kind).alias(name) for name, kind in BATCH_COLUMNS.items()]
    return silver.select(*business, *batch, F.col(PROCESSED_AT).cast("timestamp_ntz").alias(PROCESSED_AT))
