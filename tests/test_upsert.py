from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators.upsert import Clause, conditional_update, first_new, increment, insert_if_absent, merge, upsert


def test_upsert_replaces_adds_and_keeps(frame):
    old = frame([("a", 1), ("b", 2)], "k string, n int")
    new = frame([("b", 20), ("c", 30)], "k string, n int")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 20), ("c", 30)]


def test_upsert_syncs_columns(frame):
    old = frame([("a", 1, "gone")], "k string, n int, dropped string")
    new = frame([("b", 2, True)], "k string, n int, added boolean")
    merged = upsert(old, new, ["k"])
    assert merged.columns == ["k", "n", "added"]
    assert sorted(map(tuple, merged.collect())) == [("a", 1, None), ("b", 2, True)]
    fixed = upsert(old, new.withColumn("dropped", F.lit("x")), ["k"], sync_columns=False)
    assert fixed.columns == old.columns


def test_empty_increment_changes_nothing(frame):
    old = frame([("a", 1)], "k string, n int")
    assert upsert(old, old.limit(0), ["k"]).collect() == old.collect()


def test_increment_fence(frame):
    schema = "k string, at timestamp_ntz"
    df = frame([], schema)
    rows = [("a", "2020-01-01"), ("b", "2020-01-02"), ("c", "2020-01-03"), ("d", None)]
    source = df.sparkSession.createDataFrame(rows, "k string, at string").withColumn(
        "at", F.col("at").cast("timestamp_ntz")
    )
    keys = lambda frame: [r.k for r in frame.orderBy("k").collect()]
    # The last stored time is read again; earlier and unknown times are not.
    assert keys(increment(source, source.filter("k <= 'b'"), "at")) == ["b", "c"]
    assert keys(increment(source, source.limit(0), "at")) == ["a", "b", "c"]


def test_insert_if_absent(frame):
    target = frame([("a", 1)], "k string, n int")
    new = frame([("a", 9), ("b", 3), ("b", 2), ("c", None)], "k string, n int")
    added = insert_if_absent(target, new, ["k"])
    assert Counter(map(tuple, added.collect())) == Counter([("b", 2), ("c", None)])


def test_conditional_update(frame):
    df = frame([("a", "x", 1), ("b", "y", 2), (None, "z", 3)], "k string, city string, n int")
    changed = conditional_update(df, F.col("k") == "a", {"city": F.lit("t"), "n": F.lit(7)})
    assert sorted(map(repr, map(tuple, changed.collect()))) == sorted(
        map(repr, [("a", "t", 7), ("b", "y", 2), (None, "z", 3)])
    )


def test_merge_takes_the_first_clause_that_applies(frame):
    target = frame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 4, "x"), (None, 5, "x")], "k string, n int, s string")
    source = frame([("a", 10), ("b", 20), ("c", 30), ("e", 50), ("f", -1), (None, 7)], "k string, n int")
    clauses = [
        Clause("matched", "source.n = 20", delete=True),
        Clause("matched", "source.n > target.n * 10 - 1 AND target.k = 'a'", {"n": F.col("source.n") + F.col("target.n")}),
        Clause("matched"),
        Clause("new", "source.n > 0", {"s": F.lit("new")}),
        Clause("kept", "target.n = 4", {"s": F.lit("old")}),
    ]
    found = {tuple(r) for r in merge(target, source, ["k"], clauses).collect()}
    assert found == {("a", 11, "x"), ("c", 30, None), ("d", 4, "old"), (None, 5, "x"), ("e", 50, "new"), (None, 7, "new")}
    assert {tuple(r) for r in merge(target, source, ["k"], []).collect()} == {tuple(r) for r in target.collect()}
    gone = [Clause("kept", delete=True), Clause("matched", delete=True)]
    assert merge(target, source, ["k"], gone).collect() == []


def test_merge_reads_each_side_once(spark, base):
    for name in ("target", "source"):
        spark.range(20).selectExpr("id", "id AS source", "id AS target").write.parquet(f"{base}/{name}")
    target, source = (spark.read.parquet(f"{base}/{name}") for name in ("target", "source"))
    for merged in (upsert(target, source, ["id"]), merge(target, first_new(source, ["id"]), ["id"], [Clause("new")])):
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and merged.count() == 20
