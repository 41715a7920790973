"""Validation rules: conditions that a valid row must meet.

A rule is met only if its condition is TRUE; NULL counts as a failure, and a
rule for an optional column says itself that NULL is fine.  So valid rows are
a plain conjunction, which Spark can split and push down, and rejects are its
exact complement: no row can be lost between the two.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Column]  # reason of a failure, condition of a valid row


def known(name: str) -> Column:
    return F.col(name).isNotNull()


def filled(name: str) -> Column:
    """Present and not the empty string."""
    return F.length(name) > 0


def positive(name: str) -> Column:
    return F.col(name) > 0


def non_negative(name: str) -> Column:
    return F.col(name) >= 0


def one_of(name: str, allowed: Sequence[str]) -> Column:
    return F.col(name).isin(*allowed)


def none_negative(names: Iterable[str]) -> Column:
    """No measure is below zero; NULL measures are fine."""
    return reduce(Column.__and__, (F.coalesce(non_negative(n), F.lit(True)) for n in names))


def met(rules: Sequence[Rule]) -> Column:
    """TRUE for a valid row, FALSE or NULL for any other."""
    return reduce(Column.__and__, (condition for _, condition in rules))


def broken(rules: Sequence[Rule]) -> Column:
    """TRUE for a row that fails a rule, FALSE for any other."""
    return ~F.coalesce(met(rules), F.lit(False))


def first_reason(rules: Sequence[Rule]) -> Column:
    """Reason of the first rule that fails, NULL for a valid row."""
    failed = [(reason, ~F.coalesce(condition, F.lit(False))) for reason, condition in rules]
    return F.coalesce(*[F.when(condition, F.lit(reason)) for reason, condition in failed])
