"""State of ingestion and cleaning, as append-only lines per table.

High-water marks: the latest line counts.  Batches: one line when a batch is
complete in Bronze, one more when cleaning has used it; a checkpoint keeps one.
Schemas: one line for each set of columns that batches have had.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.sources.statelog import StateLog


class SchemaConflict(ValueError):
    """A column has come with different types."""


def _last_line(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.desc("seq")).limit(1)


def _per_batch(lines: DataFrame) -> DataFrame:
    return lines.groupBy("batch_id", "ingested_at").agg(
        F.max("cleaned").alias("cleaned"), F.max("rows").alias("rows")
    )


def _marks(base: str, table: str) -> StateLog:
    return StateLog(f"{base}/_marks/{table}", "watermark string, batch_id string, seq long", _last_line)


def _batches(base: str, table: str) -> StateLog:
    schema = "batch_id string, ingested_at string, cleaned boolean, rows long"
    return StateLog(f"{base}/_batches/{table}", schema, _per_batch)


def _schemas(base: str, table: str) -> StateLog:
    return StateLog(f"{base}/_schemas/{table}", "schema string, seq long")


def load_mark(spark: SparkSession, base: str, table: str) -> str | None:
    return _last(spark, base, table)["watermark"]


def save_mark(spark: SparkSession, base: str, table: str, watermark: str, batch_id: str) -> None:
    """Record a mark.  Called last, so a failed run keeps the old mark."""
    seq = (_last(spark, base, table)["seq"] or 0) + 1
    line = {"watermark": watermark, "batch_id": batch_id, "seq": seq}
    _marks(base, table).append(spark, [line])


def log_batch(
    spark: SparkSession,
    base: str,
    table: str,
    batch_id: str,
    ingested_at: str,
    cleaned: bool = False,
    rows: int | None = None,
) -> None:
    line = {"batch_id": batch_id, "ingested_at": ingested_at, "cleaned": cleaned, "rows": rows}
    _batches(base, table).append(spark, [line])


def log_cleaned(spark: SparkSession, base: str, table: str, batches: list[Row]) -> None:
    """Mark batches as used by cleaning, all in one append."""
    if batches:
        lines = [{"batch_id": b["batch_id"], "ingested_at": b["ingested_at"], "cleaned": True} for b in batches]
        _batches(base, table).append(spark, lines)


def waiting(spark: SparkSession, base: str, table: str) -> list[Row]:
    """Batches (id, ingest time, rows if known) that no cleaning run has used, oldest first."""
    open_ones = _per_batch(_batches(base, table).read(spark)).filter(~F.col("cleaned"))
    return open_ones.orderBy("ingested_at", "batch_id").select("batch_id", "ingested_at", "rows").collect()


def pending_batches(spark: SparkSession, base: str, table: str) -> list[tuple[str, str]]:
    """Ids and ingest times of the batches that wait for cleaning, oldest first."""
    return [(row["batch_id"], row["ingested_at"]) for row in waiting(spark, base, table)]


def logged_batches(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Ids of the batches that are complete in Bronze."""
    lines = _batches(base, table).read(spark)
    return lines.select(F.col("batch_id").alias("_batch_id")).distinct()


def log_schema(spark: SparkSession, base: str, table: str, schema: StructType) -> None:
    """Record the columns of a batch, if they are new; raise if one changes its type."""
    lines = _schema_lines(spark, base, table)
    logged = [StructType.fromJson(json.loads(line["schema"])) for line in lines]
    merge_schemas(table, [*logged, schema])
    text = _nullable(schema).json()
    if text not in {line["schema"] for line in lines}:
        _schemas(base, table).append(spark, [{"schema": text, "seq": len(lines)}])


def logged_schema(spark: SparkSession, base: str, table: str) -> StructType | None:
    """All columns that batches of a table have had; None before the first batch."""
    lines = _schema_lines(spark, base, table)
    return merge_schemas(table, [StructType.fromJson(json.loads(line["schema"])) for line in lines]) if lines else None


def _schema_lines(spark: SparkSession, base: str, table: str) -> list[Row]:
    return _schemas(base, table).read(spark).orderBy("seq").collect()


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(field.name, field.dataType) for field in schema])


def merge_schemas(table: str, schemas: list[StructType]) -> StructType:
    """Columns in order of first appearance; a column with two types raises and is named."""
    merged: dict[str, StructField] = {}
    for schema in schemas:
        for field in _nullable(schema):
            known = merged.setdefault(field.name, field)
            if known.dataType != field.dataType:
                found = f"{known.dataType.simpleString()} and {field.dataType.simpleString()}"
                raise SchemaConflict(f"{table}: column {field.name} has come as {found}")
    return StructType(list(merged.values()))


def _builds(base: str, table: str) -> StateLog:
    return StateLog(f"{base}/_builds/{table}", "orders_upto string, items_upto string, seq long", _last_line)


def last_build(spark: SparkSession, base: str, table: str) -> tuple[str, str] | None:
    """Ingest times up to which orders and items are in a fact; None if that is not known."""
    row = _last_line(_builds(base, table).read(spark)).first()
    return (row["orders_upto"], row["items_upto"]) if row and row["orders_upto"] else None


def log_build(spark: SparkSession, base: str, table: str, orders_upto: str | None, items_upto: str | None) -> None:
    """Record what a build has seen; a frame without any row counts as nothing seen yet."""
    row = _last_line(_builds(base, table).read(spark)).first()
    never = "1900-01-01 00:00:00"
    line = {"orders_upto": orders_upto or never, "items_upto": items_upto or never, "seq": (row["seq"] if row else 0) + 1}
    _builds(base, table).append(spark, [line])


def next_ingest_time(spark: SparkSession, base: str, table: str, wanted: str) -> str:
    """The wanted time, or a microsecond after the table's last batch if that is later.

    So the ingest times of a table's batches are all different and in the order
    of their extraction, also if a run is repeated with its own run time.
    """
    lines = _batches(base, table).read(spark)
    last = lines.agg(F.max(F.col("ingested_at").cast("timestamp_ntz"))).first()[0]
    if last is None or datetime.fromisoformat(wanted) > last:
        return wanted
    return (last + timedelta(microseconds=1)).isoformat(" ")


def _last(spark: SparkSession, base: str, table: str) -> Row:
    lines = _marks(base, table).read(spark)
    return lines.agg(F.max_by("watermark", "seq").alias("watermark"), F.max("seq").alias("seq")).first()
