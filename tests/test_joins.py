from collections import Counter

import pytest

from tidemark.operators.dedup import duplicate_keys, require_unique
from tidemark.operators.joins import (
    first_orphans,
    match_count,
    orphan_keys,
)


@pytest.fixture
def skewed(spark):
    """6,000 rows, a third of them under one key, a few without key."""
    df = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE 'k' || id % 700 END AS key",
        "id AS n",
    )
    return df.repartition(6)


@pytest.fixture
def parents(spark):
    cold = spark.range(0, 700, 2).selectExpr("'k' || id AS key", "id AS attribute")
    return cold.unionByName(spark.range(1).selectExpr("'hot' AS key", "CAST(-1 AS LONG) AS attribute"))


def test_match_count_is_the_join_size(skewed, spark):
    right = spark.range(500).selectExpr("CASE WHEN id < 9 THEN 'hot' ELSE 'k' || id % 90 END AS other")
    expected = skewed.join(right, skewed.key == right.other).count()
    assert match_count(skewed, right, "key", "other").first()[0] == expected
    assert match_count(skewed, right.filter("false"), "key", "other").first()[0] == 0


def test_orphans_against_brute_force(skewed, parents):
    rows, known = skewed.collect(), {r.key for r in parents.collect()}
    lost = Counter(r.key for r in rows if r.key is not None and r.key not in known)
    found = {r.key: r.n_rows for r in orphan_keys(skewed, "key", parents, "key").collect()}
    assert found == dict(lost)
    expected = sorted((r.n, r.key) for r in rows if r.key not in known)[:10]
    first = first_orphans(skewed, "key", parents, "key", "n", 10).collect()
    assert [(r.n, r.key) for r in first] == expected


def test_orphans_need_no_join(spark, frame):
    child = frame([("a",), ("a",), ("b",), ("b",), (None,)], "child_id string")
    parent = frame([("b",), ("b",), ("c",), (None,)], "id string")
    found = orphan_keys(child, "child_id", parent, "id")
    assert [tuple(r) for r in found.collect()] == [("a", 2)] and found.columns == ["child_id", "n_rows"]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Broadcast" not in text
    assert sorted(tuple(r) for r in orphan_keys(child, "child_id", parent.limit(0), "id").collect()) == [("a", 2), ("b", 2)]


def test_duplicates(frame):
    df = frame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    assert [tuple(r) for r in duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    require_unique(df, ["k", "n"], "t")
    with pytest.raises(ValueError, match="not unique"):
        require_unique(df, ["k"], "t")
