"""Helpers shared by the operators: staged tables, lower case, row numbers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import stage, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the operators on n-grams: runs of ASCII letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_kept: dict[str, object] = {}


def kept(name: str, make):
    """What this Python worker remembers between tasks: the thing of one name only.

    Workers are used again by later tasks, of other operators, too; asking for
    another name frees what was remembered before, so it never adds up.
    """
    if name not in _kept:
        _kept.clear()
        give_back()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return memory that this Python worker has freed to the system.

    The allocators keep what was freed for the worker's next use, and a worker
    outlives its task, so a later operator would pay for the earlier ones' peaks.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The shuffle files of the write are freed when it ends, as nothing needs
    them any more: a later step reads the table, also after a lost executor.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return stage(df)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged frame after its last use."""
    path = df.inputFiles()[:1]
    if path:
        unstage(df.sparkSession, path[0].rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else.

    ``lower`` also changes letters beyond ASCII, so it serves texts whose only
    capitals are ASCII; the others take the slower ``translate``.
    """
    other_capitals = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other_capitals, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
