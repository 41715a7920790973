"""Every registered query against its SQL, over whole tables."""

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.oracle import ORACLE
from tidemark.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_same_keys():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(ORACLE[name]).df()
    assert compare.differences(ours, theirs) == ""


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
