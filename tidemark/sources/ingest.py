"""Source to Bronze: one batch of one table, checked, then marked."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.sources.bronze import read_batch, stamp_batch, write_bronze
from tidemark.sources.marks import load_mark, log_batch, next_ingest_time, save_mark
from tidemark.sources.readers import mark_bound, mark_text, read_between


@dataclass(frozen=True)
class Source:
    """How a table is loaded; a table with a mark column loads by increment."""

    table: str
    mark_column: str | None = None

    @property
    def load_type(self) -> str:
        return "incremental" if self.mark_column else "full"


SOURCES = {
    "orders": Source("orders", "order_purchase_timestamp"),
    "customers": Source("customers"),
    "order_items": Source("order_items"),
    "products": Source("products"),
    "payments": Source("order_payments"),
}


class RowCountError(ValueError):
    """Bronze does not hold the rows that the source announced."""


@dataclass(frozen=True)
class Ingested:
    """Outcome of one extraction; ``batch_id`` is None if nothing was new."""

    table: str
    batch_id: str | None
    ingested_at: str | None
    rows: int
    mark: str | None


def validation(table: str, load_type: str, source: DataFrame, batch: DataFrame) -> DataFrame:
    """Announced and written rows of a batch, one line."""
    counted = batch.agg(F.count("*").alias("bronze_rows")).select(
        F.lit(table).alias("table_name"),
        F.lit(load_type).alias("load_type"),
        source.agg(F.count("*")).scalar().alias("expected_rows"),
        "bronze_rows",
    )
    return counted.withColumn("matches", F.col("expected_rows") == F.col("bronze_rows"))


def extract(
    df: DataFrame,
    source: Source,
    base: str,
    system: str,
    *,
    batch_id: str | None = None,
    ingested_at: str | None = None,
    full: bool = False,
    max_rows_per_file: int = 0,
) -> Ingested:
    """Append the new rows of ``df`` to Bronze.

    The upper end of an increment is fixed first, from its mark column alone.
    Then the source is read once: the rows that the write takes in are counted
    on their way (the announced rows) and compared with what can be read back.
    Rows that come in between lie beyond the end and are taken next time.

    Order of steps: read and write, count what was written, log the batch, move
    the mark.  A run that fails on the way leaves the mark alone; its rows come
    again in the next run and cleaning removes the copies.  The ingest time is
    moved behind that of the table's last batch if it does not come after it.
    Without new rows nothing is logged.
    """
    spark, column = df.sparkSession, source.mark_column
    mark = load_mark(spark, base, source.table) if column and not full else None
    rows = df
    if column:
        bound = mark_bound(df, column, mark)
        if bound is None and mark is not None:
            return Ingested(source.table, None, None, 0, mark)
        rows = read_between(df, column, mark, bound)

    batch_id = batch_id or str(uuid.uuid4())
    ingested_at = ingested_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    ingested_at = next_ingest_time(spark, base, source.table, ingested_at)
    announced = Observation()
    counted = rows.observe(announced, F.count(F.lit(1)).alias("rows"))
    stamped = stamp_batch(counted, system, source.table, batch_id, ingested_at)
    write_bronze(stamped, base, source.table, ingested_at, max_rows_per_file)
    expected = announced.get.get("rows", 0)
    if expected == 0:
        return Ingested(source.table, None, None, 0, mark)

    batch = read_batch(spark, base, source.table, batch_id, ingested_at)
    last = mark_text(F.max(column)) if column else F.lit(None).cast("string")
    found = batch.agg(F.count("*").alias("rows"), last.alias("mark")).first()
    if found["rows"] != expected:
        raise RowCountError(f"{source.table}: source has {expected} rows, Bronze got {found['rows']}")
    log_batch(spark, base, source.table, batch_id, ingested_at, rows=expected)
    if column:
        mark = found["mark"] or mark
        if mark is not None:
            save_mark(spark, base, source.table, mark, batch_id)
    return Ingested(source.table, batch_id, ingested_at, expected, mark)
