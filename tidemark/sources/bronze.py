"""Bronze: append-only Parquet history by ingest date, with batch metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.marks import log_schema, logged_schema


def stamp_batch(df: DataFrame, system: str, table: str, batch_id: str, ingested_at: str) -> DataFrame:
    """Add the four constant batch columns; the ingest time is UTC."""
    return df.withColumns(
        {
            "_ingested_at": F.lit(ingested_at).cast("timestamp_ntz"),
            "_batch_id": F.lit(batch_id),
            "_source_system": F.lit(system),
            "_source_table": F.lit(table),
        }
    )


def table_path(base: str, table: str) -> str:
    return f"{base}/bronze/{table}"


def day_path(base: str, table: str, ingested_at: str) -> str:
    """Directory of an ingest day, e.g. ``year=2024/month=01/day=31``."""
    year, month, day = ingested_at[:10].split("-")
    return f"{table_path(base, table)}/year={year}/month={month}/day={day}"


def write_bronze(
    df: DataFrame, base: str, table: str, ingested_at: str, max_rows_per_file: int = 0
) -> None:
    """Append a stamped batch to the directory of its day.

    A batch has one ingest time, so the path is known; writing to it directly
    needs neither a shuffle nor the sort of a partitioned write.
    ``max_rows_per_file`` bounds the files of a task; 0 means one file.  The
    batch's columns are logged before; one that changes its type is refused.
    """
    log_schema(df.sparkSession, base, table, df.schema)
    writer = df.write.mode("append").option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(day_path(base, table, ingested_at))


def read_bronze(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The whole history of a table, or None before its first batch.

    Batches may differ in their columns; the log of schemas says which there
    are, so no file is opened to find out, and a column of some batches only is
    NULL in the others.  Partition columns come back too; cleaning projects them
    away.
    """
    schema = logged_schema(spark, base, table)
    return None if schema is None else spark.read.schema(schema).parquet(table_path(base, table))


def read_batch(spark: SparkSession, base: str, table: str, batch_id: str, ingested_at: str) -> DataFrame:
    """Rows of one batch; only the directory of its day is listed and read."""
    reader = spark.read.schema(logged_schema(spark, base, table)).option("basePath", table_path(base, table))
    return reader.parquet(day_path(base, table, ingested_at)).filter(F.col("_batch_id") == batch_id)


def files_of(bronze: DataFrame) -> DataFrame:
    """Which files hold which batch: path, bytes and rows, from the lineage that Spark keeps of each row."""
    file = F.col("_metadata")
    lined = bronze.select("_batch_id", file["file_path"].alias("file_path"), file["file_size"].alias("file_size"))
    return lined.groupBy("_batch_id", "file_path", "file_size").agg(F.count("*").alias("n_rows"))
