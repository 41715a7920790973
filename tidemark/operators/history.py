"""Type 2 history: one row per version of a key, with validity bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest_per_key

VALID_FROM, VALID_TO = "valid_from", "valid_to"
NTZ = "timestamp_ntz"


def open_versions(history: DataFrame) -> DataFrame:
    return history.filter(F.col(VALID_TO).isNull())


def versions_of(history: DataFrame, key: str, value) -> DataFrame:
    """All versions of one key, oldest first."""
    return history.filter(F.col(key) == F.lit(value)).orderBy(VALID_FROM)


def scd2_start(current: DataFrame, ts: Column) -> DataFrame:
    """First snapshot: every row opens a version."""
    return current.withColumns({VALID_FROM: ts.cast(NTZ), VALID_TO: F.lit(None).cast(NTZ)})


def scd2_step(
    opened: DataFrame, current: DataFrame, key: str, tracked: Sequence[str], ts: Column
) -> DataFrame:
    """Next snapshot over the open versions: open rows and newly closed rows.

    Unchanged keys and keys gone from the source keep their open row as it is.
    A changed key gives two rows.  One full join on a key that is unique on
    both sides; closed history is never read.
    """
    names = opened.columns
    start = scd2_start(current, ts).select(*names)
    old = opened.select(F.col(key), F.struct(*names).alias("_old"))
    new = start.select(F.col(key), F.struct(*names).alias("_new"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    same = both & _tracked("_old", tracked).eqNullSafe(_tracked("_new", tracked))
    closed = F.col("_old").withField(VALID_TO, ts.cast(NTZ))
    kept = F.when(both & ~same, closed).otherwise(F.col("_old"))
    added = F.when(~same, F.col("_new"))
    rows = F.filter(F.array(kept, added), lambda r: r.isNotNull())
    return old.join(new, key, "full").select(F.inline(rows)).select(*names)


def scd2_apply(
    history: DataFrame, current: DataFrame, key: str, tracked: Sequence[str], ts: Column
) -> DataFrame:
    """Whole history after the next snapshot."""
    closed = history.filter(F.col(VALID_TO).isNotNull())
    return closed.unionByName(scd2_step(open_versions(history), current, key, tracked, ts))


def scd2_replay(
    batches: DataFrame, key: str, tracked: Sequence[str], at: str, newest: Sequence[str]
) -> DataFrame:
    """History from all batches at once; ``at`` is the time of a batch.

    Copies within one batch are removed first, so a key has at most one row
    per batch and the windows below are bounded by the number of batches.
    """
    single = latest_per_key(batches, [key, at], newest)
    by_time = Window.partitionBy(key).orderBy(at)
    values = F.struct(*tracked)
    changed = single.withColumn("_changed", ~values.eqNullSafe(F.lag(values).over(by_time)))
    return (
        changed.filter("_changed")
        .drop("_changed")
        .withColumns({VALID_FROM: F.col(at).cast(NTZ), VALID_TO: F.lead(at).over(by_time).cast(NTZ)})
    )


def _tracked(row: str, names: Sequence[str]) -> Column:
    return F.struct(*[F.col(row)[name].alias(name) for name in names])
