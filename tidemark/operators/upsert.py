"""Keyed writes expressed as joins, for tables without MERGE."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import first_rows_per_key


def increment(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Source rows at or after the highest ``column`` value of the target.

    An empty target lets every row with a known time through.
    """
    floor = F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")
    fence = target.agg(F.coalesce(F.max(column), floor)).scalar()
    return source.filter(F.col(column) >= fence)


@dataclass(frozen=True)
class Clause:
    """What to do with a row of a merge.

    ``when`` is ``matched`` (key on both sides), ``new`` (source only) or ``kept``
    (target only).  ``condition`` is SQL text or a column over ``target`` and
    ``source``, two structs.  ``values`` are the columns to set, also over these;
    None takes the source's row, or the target's for ``kept``.  ``delete`` drops it.
    """

    when: str
    condition: Column | str | None = None
    values: dict[str, Column] | None = None
    delete: bool = False


def merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], clauses: Sequence[Clause], columns: Sequence[str] | None = None
) -> DataFrame:
    """The target after a merge with ``source``; each side is read once.

    The first clause that applies to a row decides.  Without one, target rows
    stay as they are and source rows are left out.  Keys must be unique in the
    source (see ``require_unique``); NULL keys match nothing.  ``columns`` are
    those of the result (default: the target's); one that a side lacks is NULL.
    """
    columns = list(columns or target.columns)
    side = {"target": set(target.columns), "source": set(source.columns)}
    kinds = {f.name: f.dataType for f in [*source.schema, *target.schema]}
    packed = [
        df.select(*(F.col(k).alias(f"_{name}_{i}") for i, k in enumerate(keys)), F.struct(*df.columns).alias(name))
        for df, name in ((target, "target"), (source, "source"))
    ]
    same = reduce(Column.__and__, (F.col(f"_target_{i}") == F.col(f"_source_{i}") for i in range(len(keys))))
    inserts = any(c.when == "new" and not c.delete for c in clauses)
    both = packed[0].join(packed[1], same, "full" if inserts else "left")
    old, new = F.col("target").isNotNull(), F.col("source").isNotNull()
    states = {"matched": old & new, "new": ~old & new, "kept": old & ~new}

    def applies(clause: Clause) -> Column:
        if clause.condition is None:
            return states[clause.when]
        condition = F.expr(clause.condition) if isinstance(clause.condition, str) else clause.condition
        return states[clause.when] & F.coalesce(condition, F.lit(False))

    def of(name: str, column: str) -> Column:
        return F.col(name)[column] if column in side[name] else F.lit(None).cast(kinds[column])

    number = F.lit(None).cast("int")
    for i, clause in reversed(list(enumerate(clauses))):
        number = F.when(applies(clause), F.lit(i)).otherwise(number)
    decided = both.withColumn("_clause", number)
    gone = [i for i, c in enumerate(clauses) if c.delete]
    left = F.col("_clause").isNotNull() | old
    decided = decided.where(left & ~F.coalesce(F.col("_clause").isin(gone), F.lit(False)) if gone else left)
    out = []
    for column in columns:
        value = of("target", column)
        for i, clause in enumerate(clauses):
            if clause.delete:
                continue
            base = "target" if clause.when == "kept" else "source"
            if clause.values is None:
                then = of(base, column)
            else:
                base = "source" if clause.when == "new" else "target"
                then = clause.values.get(column, of(base, column))
            value = F.when(F.col("_clause") == i, then).otherwise(value)
        out.append(value.alias(column))
    return decided.select(*out)


def upsert(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], sync_columns: bool = True
) -> DataFrame:
    """Replace target rows with equal keys, add the others, keep the rest.

    ``incoming`` must be unique on ``keys`` (see ``require_unique``).  With
    ``sync_columns`` the result has the columns of ``incoming``: new ones are
    NULL in old rows, and columns that left the model are dropped.
    """
    columns = incoming.columns if sync_columns else target.columns
    return merge(target, incoming, keys, [Clause("matched"), Clause("new")], columns)


def insert_if_absent(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to append: first row per key, keys not in the target.

    Among new rows with one key, the smallest by all other columns wins.  To get
    the whole target in one pass, ``merge`` with ``first_new`` and one clause.
    """
    added = [Clause("matched", delete=True), Clause("kept", delete=True), Clause("new")]
    return merge(target, first_new(new, keys), keys, added)


def first_new(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the smallest by all other columns."""
    return first_rows_per_key(new, keys, [c for c in new.columns if c not in keys], 1)


def conditional_update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns in the rows where the condition is true; no other table, so no merge."""
    return df.withColumns(
        {name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()}
    )
