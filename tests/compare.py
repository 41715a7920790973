"""Run a registered query in Spark and its oracle in DuckDB, compare rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events"
    " documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    names = sorted(pdf.columns)
    cells = [tuple(_cell(v) for v in row) for row in pdf[names].itertuples(index=False)]
    return sorted(cells, key=repr)


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    """Empty if both hold the same columns and rows."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    kinds = {
        name: (spark_pdf[name].dtype, duck_pdf[name].dtype)
        for name in spark_pdf.columns
        if spark_pdf[name].dtype.kind != duck_pdf[name].dtype.kind
    }
    left, right = rows(spark_pdf), rows(duck_pdf)
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b][:3]
        return f"{len(left)} rows vs {len(right)}; first differences {bad}"
    return f"dtypes {kinds}" if kinds and left else ""
