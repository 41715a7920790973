"""Reading the source system, in full or from a high-water mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_ROWS = 50_000


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    splits: int,
    properties: dict[str, str] | None = None,
    fetch_rows: int = FETCH_ROWS,
    split_by: str | None = None,
    bounds: tuple[str, str] | None = None,
    hash_of: str | None = None,
) -> DataFrame:
    """One database table in ``splits`` parallel reads.

    Filters and columns are pushed into the queries.  ``split_by`` with
    ``bounds`` cuts a number, date or time column into ranges; rows outside the
    bounds go to the first and last range.  ``hash_of`` deals a column of any
    type, text keys too, by its hash.  No row is lost either way.  A read in
    one task has to be asked for by ``splits=1``.
    """
    if splits > 1 and (split_by is None) == (hash_of is None):
        raise ValueError("several splits need either split_by or hash_of")
    if splits > 1 and hash_of:
        options = jdbc_options(url, table, properties, fetch_rows)
        url, name = options.pop("url"), options.pop("dbtable")
        return spark.read.jdbc(url, name, predicates=hash_predicates(hash_of, splits), properties=options)
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, properties, fetch_rows, split_by, bounds, splits)
    ).load()


def jdbc_options(
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    fetch_rows: int = FETCH_ROWS,
    split_by: str | None = None,
    bounds: tuple[str, str] | None = None,
    splits: int = 1,
) -> dict[str, str]:
    options = {
        **(properties or {}),
        "url": url,
        "dbtable": quoted(table),
        "fetchsize": str(fetch_rows),
        "preferTimestampNTZ": "true",
    }
    if split_by:
        if bounds is None:
            raise ValueError("split_by needs bounds")
        options.update(
            partitionColumn=split_by,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(splits),
        )
    return options


def hash_predicates(column: str, splits: int) -> list[str]:
    """Conditions, in PostgreSQL's SQL, that deal every row to exactly one split."""
    name = quoted(column)
    part = f"mod(cast(hashtext(cast({name} as text)) as bigint) + 2147483648, {splits})"
    return [f"{name} is null or {part} = 0", *(f"{part} = {i}" for i in range(1, splits))]


def quoted(table: str) -> str:
    """Table name as SQL identifiers, so that it cannot carry SQL."""
    return ".".join('"' + part.replace('"', '""') + '"' for part in table.split("."))


def read_increment(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows after the mark, or all rows while there is no mark.

    Strictly after: rows with a NULL time, and rows that tie with the mark,
    are not read again.
    """
    if mark is None:
        return df
    return df.filter(F.col(column) > F.lit(mark).cast("timestamp_ntz"))


def mark_bound(df: DataFrame, column: str, mark: str | None) -> str | None:
    """Highest time after the mark, as text; None if there is none.  Reads one column."""
    return read_increment(df, column, mark).agg(mark_text(F.max(column))).first()[0]


def read_between(df: DataFrame, column: str, mark: str | None, bound: str | None) -> DataFrame:
    """Rows after the mark up to and including the bound.

    Without a mark rows of unknown time belong to it, too.  Without a bound
    there were none with a time.
    """
    time = F.col(column)
    if bound is None:
        return df.filter(time.isNull()) if mark is None else read_increment(df, column, mark)
    upto = time <= F.lit(bound).cast("timestamp_ntz")
    return read_increment(df, column, mark).filter(upto if mark is not None else upto | time.isNull())


def mark_text(time: Column) -> Column:
    return time.cast("timestamp_ntz").cast("string")


def max_mark(df: DataFrame, column: str) -> DataFrame:
    """Highest time of a batch as text; NULL for a batch without times."""
    return df.agg(F.max(column).alias("_max")).select(mark_text(F.col("_max")).alias("watermark"))
